"""SQL fragments that mirror the column functions, for the DuckDB oracles.

Each helper returns ANSI/DuckDB SQL text equal in meaning to the matching
Spark column expression in ``thematica.functions``.
"""

from __future__ import annotations

from ..functions.lexicon import Lexicon


def clean(expr: str) -> str:
    """T01 in SQL."""
    return f"nullif(lower(trim(regexp_replace({expr}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))), '')"


def clean_r(expr: str) -> str:
    """T02 in SQL."""
    return (f"trim(regexp_replace(regexp_replace(lower({expr}), '\\p{{P}}', ' ', 'g'), "
            f"'[\\s\\p{{Z}}]+', ' ', 'g'))")


def match(clean_expr: str, lex: Lexicon) -> str:
    """T04 in SQL: padded whole-word alternation."""
    if not lex.entries:
        return "false"
    pat = lex.pattern().replace("'", "''")
    return f"coalesce(regexp_matches(' ' || coalesce({clean_expr}, '') || ' ', '{pat}'), false)"


def lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def hits(tokens_expr: str, lex: Lexicon) -> str:
    """Distinct single-word entries present in a token list."""
    return f"len(list_distinct(list_intersect({tokens_expr}, {lit_list(lex.single)})))"


def sigmoid(expr: str) -> str:
    return f"(1 / (1 + exp(-({expr}))))"


def tokens(clean_expr: str) -> str:
    return f"string_split(coalesce({clean_expr}, ''), ' ')"


def in_digits(col: str) -> str:
    return f"coalesce({col} IN (0, 1, 2), false)"


def screened(group: str) -> str:
    if group == "climate":
        return f"({in_digits('climate_adaptation')} OR {in_digits('climate_mitigation')})"
    return in_digits({"gender": "gender", "disability": "disability"}[group])


def all_screened() -> str:
    return f"({screened('gender')} AND {screened('climate')} AND {screened('disability')})"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def money_sum(expr: str) -> str:
    """Money total without any rounding of rows (compensated double sum)."""
    return f"fsum({expr})"
