"""SQL fragments shared by the DuckDB counterparts."""

# White space of Unicode, for an engine whose \s is ASCII.
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DROP = """chr(10)||chr(9)||' （），、。：“”【】!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"""


def q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def replace(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, 'g')"


def trim(expr: str) -> str:
    return replace(expr, rf"^{WS}+|{WS}+$")


def normalize(expr: str) -> str:
    return f"translate(lower({expr}), {DROP}, '')"


def lines(expr: str) -> str:
    """Lines of a text; a final line end opens no further line."""
    body = replace(expr, r"\r?\n\z")
    return f"CASE WHEN {expr} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({body}, {q(chr(92) + 'r?' + chr(92) + 'n')}) END"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists of characters."""
    return (
        f"list_reduce({a}, lambda acc, ch: list_reduce(range(1, len({b}) + 1), lambda cur, j: list_append(cur, CASE WHEN {b}[j] = ch THEN acc[j] + 1 "
        f"ELSE greatest(cur[j], acc[j + 1]) END), [0::BIGINT]), list_transform(range(0, len({b}) + 1), lambda i: 0::BIGINT))[-1]"
    )


def f1(a: str, b: str, common: str) -> str:
    """Character F1 from two texts and their common length, in the order the scorer computes it."""
    p, r = f"({common}::DOUBLE / length({a}))", f"({common}::DOUBLE / length({b}))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN {common} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {p} * {r} / ({p} + {r}) END"
