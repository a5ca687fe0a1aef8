"""Small SQL text helpers for the DuckDB oracle."""


def sdiv(a: str, b: str) -> str:
    """Division with 0/0 = 0 (library convention)."""
    return f"(CASE WHEN ({b}) = 0 OR ({b}) IS NULL THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def f1(p: str, r: str) -> str:
    return sdiv(f"2.0::DOUBLE * {p} * {r}", f"({p}) + ({r})")


def qlist(values) -> str:
    return "[" + ", ".join(repr(float(v)) + "::DOUBLE" for v in values) + "]"


def avg_rank(col: str, src_part: str = "") -> str:
    """Average 1-based rank of ``col`` over the whole input (tie-aware)."""
    return (f"(rank() OVER ({src_part} ORDER BY {col}) + "
            f"(count(*) OVER ({src_part} PARTITION BY {col}) - 1) / 2.0::DOUBLE)").replace("( PARTITION", "(PARTITION")
