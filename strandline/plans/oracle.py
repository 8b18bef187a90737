"""The shared tables in SQL: what `fixtures` makes, as common table expressions on text."""

from __future__ import annotations

from .fixtures import GROWN_AT, GROWN_EVERY, WINDOWS

_PICK = " OR ".join(f"(contig_id = {c} AND start = {s})" for _, c, s in WINDOWS)
_NAME = " ".join(f"WHEN contig_id = {c} THEN '{q}'" for q, c, _ in WINDOWS)

GENOME = """
g0 AS (SELECT doc_id AS contig_id, 'doc' || doc_id AS name, lang, source,
         translate(regexp_replace(lower(coalesce(text, '')), '[^a-z\n]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz\n', 'ACGTACGTACGTACGTACGTACGTACN') AS seq FROM documents),
g AS (SELECT *, length(seq)::BIGINT AS len, (coalesce(sum(length(seq)) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM g0),
gl AS (SELECT coalesce(sum(len), 0)::BIGINT AS n FROM g)"""

#: The genome's length.
L = "(SELECT n FROM gl)"

SITES = (
    GENOME
    + """,
tl AS (SELECT contig_id, off, a, substr(seq, a + 1, 542) AS bit FROM (SELECT contig_id, off, seq, unnest(range(0, len - 30, 512)) AS a FROM g WHERE len >= 31)),
tr AS (SELECT *, length(bit) AS n, reverse(translate(bit, 'ACGT', 'TGCA')) AS rev FROM tl),
w0 AS (SELECT contig_id, a + i AS start, off + a + i AS pos, substr(bit, i + 1, 31) AS fwd, substr(rev, n - i - 30, 31) AS rc FROM (SELECT *, unnest(range(n - 30)) AS i FROM tr)),
w AS (SELECT contig_id, start, pos, fwd, rc, least(fwd, rc) AS kmer, fwd <= rc AS fc FROM w0 WHERE NOT contains(fwd, 'N')),
k AS (SELECT kmer, count(*) AS copies FROM w GROUP BY kmer)"""
)

QUERIES = (
    SITES
    + f""",
q AS (SELECT CASE {_NAME} END AS query_id, fwd AS q FROM w WHERE {_PICK}
      UNION ALL SELECT * FROM (SELECT 'top', kmer FROM k ORDER BY copies DESC, kmer LIMIT 1))"""
)


GROWN = (
    SITES
    + f""",
gq AS MATERIALIZED (SELECT 'u' || contig_id AS query_id, fwd AS q, pos AS own FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY contig_id) AS r FROM w WHERE contig_id % {GROWN_EVERY} = 0 AND start = {GROWN_AT}) WHERE r = 1)"""
)


def twins(tries: int) -> str:
    """In SQL, the first of so many orders of each query's letters that the genome lacks.  Stands after GROWN."""
    return f""",
tt AS (SELECT query_id, q, t, unnest(range(31)) AS i FROM (SELECT 'unique_shuf/' || query_id AS query_id, q, unnest(range({tries})) AS t FROM gq)),
ts_ AS (SELECT query_id, t, string_agg(substr(q, i::INTEGER + 1, 1), '' ORDER BY md5(query_id || '-0-' || t || '-' || i)) AS q FROM tt GROUP BY query_id, t),
tw AS MATERIALIZED (SELECT query_id, arg_min(q, t) AS q FROM ts_ a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kmer = least(a.q, reverse(translate(a.q, 'ACGT', 'TGCA')))) GROUP BY query_id)"""


def variants(n: int) -> str:
    return (
        QUERIES
        + f""",
q2 AS (SELECT query_id, q, q AS o, false AS flipped FROM q UNION ALL SELECT query_id, q, reverse(translate(q, 'ACGT', 'TGCA')), true FROM q),
v0 AS (SELECT query_id, q, CASE WHEN flipped THEN reverse(translate(kmer, 'ACGT', 'TGCA')) ELSE kmer END AS variant, hamming(kmer, o)::INTEGER AS mismatches, kmer AS leaf, flipped, copies
       FROM k, q2 WHERE hamming(kmer, o) <= {n}),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mismatches, leaf, flipped) - 1 AS vi FROM v0),
s AS (SELECT v.query_id, v.q, v.vi, w.pos, w.contig_id, w.start, CASE WHEN w.fc <> v.flipped THEN '+' ELSE '-' END AS strand, v.variant, v.mismatches
      FROM v JOIN w ON v.leaf = w.kmer)"""
    )


def ordered(n: int, at: int) -> str:
    """Characters, ranks, keys and rows of the variants within n of a result of `variants(n or more)`, ranked by those within `at`."""
    chars = "list_transform(list_filter(range(31), lambda i: substr(q, i + 1, 1) <> substr(variant, i + 1, 1)), lambda i: 4 * i + strpos('ACGT', substr(variant, i + 1, 1)) - 1)"
    return f""",
ch AS (SELECT query_id, vi, unnest({chars})::INTEGER AS char FROM v WHERE mismatches <= {at}),
rk AS (SELECT query_id, char, count(*) AS n_variants, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, char)::INTEGER AS rank FROM ch GROUP BY query_id, char),
ks AS (SELECT query_id, vi, list_sort(list(rank)) AS key FROM (SELECT query_id, vi, unnest({chars})::INTEGER AS char FROM v WHERE mismatches <= {n}) JOIN rk USING (query_id, char) GROUP BY query_id, vi),
o0 AS (SELECT v.query_id, v.vi, v.variant, v.mismatches, coalesce(ks.key, []::INTEGER[]) AS key FROM v LEFT JOIN ks USING (query_id, vi) WHERE v.mismatches <= {n}),
o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key) - 1 AS row_, lag(key) OVER (PARTITION BY query_id ORDER BY key) AS was FROM o0),
o AS (SELECT *, coalesce(len(list_filter(range(1, least(len(key), len(was)) + 1), lambda i: key[1:i] = was[1:i])), 0)::INTEGER AS lcp FROM o1)"""


FEATURES = (
    GENOME
    + """,
p AS (SELECT contig_id, off, lang, source, unnest(string_split(seq, 'N')) AS piece, generate_subscripts(string_split(seq, 'N'), 1) AS i FROM g),
f0 AS (SELECT *, off + coalesce(sum(length(piece) + 1) OVER (PARTITION BY contig_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
f AS (SELECT 'lines' AS set_, start::BIGINT AS start, (start + length(piece))::BIGINT AS end_, lang AS kind, source AS name, CASE WHEN length(piece) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM f0 WHERE length(piece) > 0)"""
)

#: Stands after GENOME.
SIGNAL = """
sg AS (SELECT event_type AS track, date_diff('second', TIMESTAMP '2024-01-01', ts) % (SELECT greatest(n, 1) FROM gl) AS start, date_diff('second', TIMESTAMP '2024-01-01', ts) % (SELECT greatest(n, 1) FROM gl) + 64 AS end_, value
       FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
sb AS (SELECT *, unnest(range(start // 32, (end_ - 1) // 32 + 1)) AS bin FROM sg),
b0 AS (SELECT track, bin, sum(value * (least(end_, (bin + 1) * 32) - greatest(start, bin * 32))) AS total, sum(least(end_, (bin + 1) * 32) - greatest(start, bin * 32)) AS cov, max(value) AS high
       FROM sb GROUP BY track, bin)"""
