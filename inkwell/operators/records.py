"""Months, caps, key sets and settings files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from inkwell.plans.dialect import Dialect

#: Papers of one journal and month at most.
CAP = 3


def month_bounds(d: Dialect) -> str:
    """First and last day of each month that orders fall into, as a search states them."""
    first = "CAST(date_trunc('month', o_orderdate) AS DATE)"
    return f"""WITH months AS (SELECT DISTINCT {first} AS first_day FROM {d.table('orders')} WHERE o_orderdate IS NOT NULL)
    SELECT CAST(year(first_day) AS BIGINT) AS year, CAST(month(first_day) AS BIGINT) AS month, '[' || CAST(first_day AS STRING) || ' TO ' || CAST(last_day(first_day) AS STRING) || ']' AS bounds FROM months"""


def group_cap(d: Dialect) -> str:
    """The largest number of documents of a source in each month, and whether it keeps to CAP."""
    return f"""WITH counted AS (SELECT doc_id % 12 + 1 AS month, source, CAST(count(*) AS BIGINT) AS n FROM {d.table('documents')} GROUP BY doc_id % 12 + 1, source)
    SELECT CAST(month AS BIGINT) AS month, max(n) AS most, max(n) <= {CAP} AS kept FROM counted GROUP BY month"""


def key_sets(d: Dialect) -> str:
    """Whether each conversation's map from role to turns has the same keys as the map of all conversations."""
    return f"""WITH roles AS (SELECT DISTINCT conv_id, role FROM {d.table('conversations')}), own AS (SELECT conv_id, {d.gather('role', 'role', ',')} AS roles FROM roles GROUP BY conv_id),
    every AS (SELECT {d.gather('role', 'role', ',')} AS all_roles FROM (SELECT DISTINCT role FROM {d.table('conversations')}) x)
    SELECT conv_id, roles, roles = all_roles AS complete FROM own CROSS JOIN every"""


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """Each scalar and empty container of a JSON value, by its path."""
    if isinstance(value, dict | list) and value:
        pairs = value.items() if isinstance(value, dict) else enumerate(value)
        for key, inner in pairs:
            yield from leaves(inner, f"{path}/{key}")
    else:
        yield path, json.dumps(value)


def same_but(left: object, right: object, *paths: str) -> bool:
    """Whether two JSON values are equal outside these paths ('/model/merges')."""
    kept = lambda value: {p: v for p, v in leaves(value) if not any(p == x or p.startswith(f"{x}/") for x in paths)}
    return kept(left) == kept(right)


def tokenizer_invariants(left: dict, right: dict) -> dict[str, bool]:
    """What two tokenizers must share when only the order or the choice of merges differs."""
    part = lambda *names: all(left.get(n) == right.get(n) for n in names)
    return {
        "vocabulary": left.get("model", {}).get("vocab") == right.get("model", {}).get("vocab"),
        "special_tokens": part("added_tokens", "post_processor"),
        "normalizer": part("normalizer"),
        "pre_tokenizer": part("pre_tokenizer"),
        "decoder": part("decoder"),
        "all_but_merges": same_but(left, right, "/model/merges"),
    }


QUERIES = (month_bounds, group_cap, key_sets)
