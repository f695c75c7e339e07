"""Small SQL text helpers for the check queries."""


def msum(expr: str) -> str:
    """Exact sum of cents as a double."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)
