"""DuckDB text of ``op13_merkle``: the same trees level by level, one table per level."""

from __future__ import annotations

#: Levels written out: enough for 2^24 rows of a language and 2^12 languages.
DOCUMENT_LEVELS, LANGUAGE_LEVELS = 24, 12

#: CRC-32 of a decimal number's digits; 3988292384 is the polynomial and 4294967295 the start and end mask of that checksum.
CRC32 = """xor(4294967295, list_reduce([CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda crc, byte: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), 4294967295))"""


def _encoded(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_encoded, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _tree(name: str, levels: int) -> str:
    """Tables {name}0 (g, i, h) to {name}{levels}, each half as long until one node per g is left."""
    return ",\n".join(
        f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 2 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
        f"(any_value(n) + 1) // 2 AS n FROM {name}{k} GROUP BY g, i // 2)"
        for k in range(levels)
    )


def _climb(name: str, tree: str, levels: int) -> str:
    """Tables {name}0 (g, i, proof, f, more) to {name}{levels}: proof and folded digest over one more level each."""
    return ",\n".join(
        f"{name}{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (p.i // 2 AS i, p.proof || coalesce(s.h, '') AS proof, CASE WHEN t.n = 1 THEN p.f WHEN p.i % 2 = 0 THEN sha256(p.f || coalesce(s.h, '')) "
        f"ELSE sha256(s.h || p.f) END AS f) FROM {name}{k} p JOIN {tree}{k} t ON t.g = p.g AND t.i = p.i LEFT JOIN {tree}{k} s ON s.g = p.g AND s.i = xor(p.i, 1))"
        for k in range(levels)
    )


def manifest_sql() -> str:
    return f"""
        WITH d AS MATERIALIZED (
            SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf('n_chars')} AS leaf, CASE WHEN {CRC32} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS claimed FROM documents
        ),
        e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        a0 AS MATERIALIZED (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM e),
        {_tree("a", DOCUMENT_LEVELS)},
        b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, count(*) OVER () AS n, g AS lang FROM a{DOCUMENT_LEVELS}),
        {_tree("b", LANGUAGE_LEVELS)},
        p0 AS MATERIALIZED (SELECT doc_id, leaf, g, i, '' AS proof, coalesce(claimed, leaf) AS f FROM e),
        {_climb("p", "a", DOCUMENT_LEVELS)},
        q0 AS MATERIALIZED (SELECT doc_id, leaf, 0 AS g, b0.i, proof, f, b0.h AS subroot FROM p{DOCUMENT_LEVELS} p JOIN b0 ON b0.lang = p.g),
        {_climb("q", "b", LANGUAGE_LEVELS)}
        SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
        FROM q{LANGUAGE_LEVELS} q JOIN b{LANGUAGE_LEVELS} r ON r.g = q.g
    """
