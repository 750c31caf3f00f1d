"""Named queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

import functools

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) -> DataFrame; columns in `dates` are shown as text on both sides."""

    def keep(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            out = f(spark, sf_dir)
            return out.withColumns({d: out[d].cast("string") for d in dates}) if dates else out

        QUERIES[name] = run
        if oracle:
            shown = ", ".join(f"cast({d} as varchar) as {d}" for d in dates)
            ORACLES[name] = f"select * replace ({shown}) from ({oracle})" if dates else oracle
        return run

    return keep
