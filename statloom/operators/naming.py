"""Column names of any kind: operators work on reserved names, callers see their own."""

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column with exactly this name, dots and quotes included."""
    return F.col(quoted(name))


def unused(name: str, taken: list[str]) -> str:
    """`name`, lengthened until no column is called so."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def plain_names(*params: str, told: tuple[str, ...] = ()) -> Callable:
    """Run an operator on a frame whose columns, those named by `params`, have reserved names, and give them their own names back.

    The first argument is the frame. Result columns listed in `told` hold column names as values; these are translated. A column of the
    caller that comes back beside a result column of the same name is called `<name>_by`.
    """
    def wrap(fn: Callable) -> Callable:
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def run(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            given = bound.arguments
            frame = next(iter(given))
            df = given[frame]
            names = []
            for p in params:
                v = given[p]
                names += [v] if isinstance(v, str) else list(v or ())
            inner = {n: f"_u{i}" for i, n in enumerate(dict.fromkeys(names))}
            given[frame] = df.select(*[col(n).alias(i) for n, i in inner.items()])
            for p in params:
                v = given[p]
                given[p] = inner[v] if isinstance(v, str) else v if v is None else [inner[n] for n in v]
            out = fn(*bound.args, **bound.kwargs)
            own = {i: n for n, i in inner.items()}
            taken = {c.lower() for c in out.columns if c not in own}
            columns = []
            for c in out.columns:
                if c in own:
                    columns.append(col(c).alias(f"{own[c]}_by" if own[c].lower() in taken else own[c]))
                elif c in told:
                    columns.append(F.coalesce(F.try_element_at(_map(own), col(c)), col(c)).alias(c))
                else:
                    columns.append(col(c))
            return out.select(*columns)

        return run

    return wrap


def _map(own: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
