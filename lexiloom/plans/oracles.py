"""DuckDB SQL of the library's queries."""

from __future__ import annotations

from lexiloom.functions.text import LONGEST_WORD, STOP_WORDS
from lexiloom.plans.fixtures import DOCUMENTS
from lexiloom.sources.corpus import LICENCE_FORMS

_SET = r"\r\n,.!?\"\-_:;(){}"
K = 10


def words(name: str, source: str, ident: str, text: str = "text") -> str:
    """A CTE of ident, word. DuckDB has no Latin-1 view of a string, so bytes are rewritten as pairs of hex digits."""
    return rf"""{name} AS (
  SELECT {ident}, word FROM (
    SELECT {ident}, lower(decode(unhex(replace(regexp_replace(regexp_replace(hex(encode(w)), '(..)', '\1 ', 'g'),
             '[89A-F][0-9A-F] (.. )?(.. )?', '27 ', 'g'), ' ', '')))) AS word
    FROM (SELECT {ident}, regexp_replace(regexp_replace(regexp_extract(t, '^[{_SET}]*([^{_SET}]*)', 1),
                   '^[^\x00-\x7F]+', ''), '[^\x00-\x7F]+$', '') AS w
          FROM (SELECT {ident}, unnest(string_split(line, ' ')) AS t
                FROM (SELECT {ident}, unnest(string_split({text}, chr(10))) AS line FROM {source}) WHERE strlen(line) > 0)
          WHERE t <> ''))
  WHERE length(word) BETWEEN 1 AND {LONGEST_WORD})"""


TOK = words("tok", "documents", "doc_id")
TERMS = TOK + ",\nterms AS MATERIALIZED (SELECT doc_id, word, count(*) AS cnt FROM tok GROUP BY ALL)"
LAST = "CASE WHEN word >= 'a' AND word < '{' THEN 0 ELSE 1 END"
VOCAB = (
    TERMS
    + f""",
vocab AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {LAST}, word) - 1 AS INT) AS word_idx, word, df, occ
          FROM (SELECT word, count(*) AS df, CAST(sum(cnt) AS BIGINT) AS occ FROM terms GROUP BY word))"""
)
IDF = "ln(CAST((SELECT count(*) FROM documents) // df AS DOUBLE))"
TFIDF = (
    TERMS
    + f""",
tf AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY doc_id) AS tf FROM terms),
idf AS (SELECT word, df, {IDF} AS idf FROM (SELECT word, count(*) AS df FROM terms GROUP BY word)),
scored AS (SELECT doc_id, word, cnt, tf, df, idf, tf * idf AS tfidf FROM tf JOIN idf USING (word))"""
)


DICTIONARY = words("dict", "benchmark", "item_id") + ",\nlisted AS MATERIALIZED (SELECT DISTINCT word FROM dict)"
FIXED_VOCAB = f"""fixed AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {LAST}, word) - 1 AS INT) AS word_idx, word, df, occ
  FROM (SELECT l.word, count(t.doc_id) AS df, CAST(coalesce(sum(t.cnt), 0) AS BIGINT) AS occ FROM listed l LEFT JOIN terms t USING (word) GROUP BY l.word))"""


def blocks(p: int) -> str:
    return f"blocks AS (SELECT doc_id, CAST(ntile({p}) OVER (ORDER BY doc_id) - 1 AS INT) AS proc FROM documents)"


SERPENTINE = """dealt AS (
  SELECT doc_id, size, CAST(CASE WHEN (q // 7) % 2 = 0 OR q // 7 = n // 7 THEN q % 7 ELSE 6 - q % 7 END AS INT) AS proc, CAST(q // 7 AS INT) AS place
  FROM (SELECT doc_id, size, row_number() OVER (ORDER BY size DESC, doc_id) - 1 AS q, count(*) OVER () AS n
        FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size FROM documents)))"""
SPREAD = (
    VOCAB
    + ",\n"
    + blocks(4)
    + """,
spread AS MATERIALIZED (SELECT word_idx, CAST(count(DISTINCT proc) AS INT) AS spread FROM terms JOIN vocab USING (word) JOIN blocks USING (doc_id) GROUP BY word_idx)"""
)
PLACED = (
    SPREAD
    + """,
size AS (SELECT greatest(1, count(*) // 4) AS c, count(*) AS n FROM vocab),
placed0 AS (SELECT word_idx, chunk, row_number() OVER (PARTITION BY chunk ORDER BY spread DESC, word_idx) - 1 AS nth
            FROM (SELECT word_idx, spread, CAST(least(word_idx // c, 3) AS INT) AS chunk FROM spread, size)),
placed AS MATERIALIZED (SELECT word_idx, chunk, pw, CAST(row_number() OVER (PARTITION BY pw ORDER BY chunk, nth) - 1 AS INT) AS row_in_pw
           FROM (SELECT *, CAST((chunk + nth) % 3 AS INT) AS pw FROM placed0))"""
)
LOCAL = """
occ AS MATERIALIZED (SELECT proc AS prank, word_idx, CAST(sum(cnt) AS BIGINT) AS occ FROM terms JOIN vocab USING (word) JOIN blocks USING (doc_id) GROUP BY ALL)"""
# Each owner's words in order of local occurrences: the k-th bundle begins with the k-th from the end and goes on with the
# k-th run of 7 from the front, as far as the words that begin no bundle go.
BUNDLES = (
    PLACED
    + ","
    + LOCAL
    + """,
own AS MATERIALIZED (SELECT prank, word_idx, pw, row_number() OVER (PARTITION BY prank, pw ORDER BY occ, word_idx) AS up,
               row_number() OVER (PARTITION BY prank, pw ORDER BY occ DESC, word_idx DESC) AS down FROM occ JOIN placed USING (word_idx)),
many AS (SELECT prank, pw, (count(*) + 7) // 8 AS bundles FROM own GROUP BY ALL),
heads AS MATERIALIZED (SELECT prank, pw, down AS k, word_idx, row_number() OVER (PARTITION BY prank ORDER BY word_idx) - 1 AS bundle
          FROM own JOIN many USING (prank, pw) WHERE down <= bundles),
tails AS (SELECT prank, pw, word_idx, (up + 6) // 7 AS k, (up - 1) % 7 + 1 AS slot FROM own JOIN many USING (prank, pw) WHERE down > bundles),
bundles AS (SELECT prank, CAST(bundle AS INT) AS bundle, 0 AS slot, word_idx, pw FROM heads
            UNION ALL
            SELECT h.prank, CAST(h.bundle AS INT), CAST(r.slot AS INT), coalesce(t.word_idx, -1), h.pw
            FROM heads h CROSS JOIN range(1, 8) r(slot) LEFT JOIN tails t ON t.prank = h.prank AND t.pw = h.pw AND t.k = h.k AND t.slot = r.slot)"""
)
STATE = (
    VOCAB
    + f""",
occurrences AS (SELECT doc_id, word, unnest(range(1, cnt + 1)) AS i FROM terms),
z AS (SELECT doc_id, word, i, CAST(CAST('0x' || substr(md5(concat_ws('|', doc_id, word, i)), 1, 8) AS BIGINT) % {K} AS INT) AS k FROM occurrences)"""
)
PHI = (
    STATE
    + f""",
nwk AS (SELECT word, k, count(*) AS n FROM z GROUP BY ALL),
grid AS (SELECT v.word_idx, v.word, g.k, coalesce(nwk.n, 0) AS n
         FROM vocab v CROSS JOIN (SELECT CAST(unnest(range({K})) AS INT) AS k) g LEFT JOIN nwk ON nwk.word = v.word AND nwk.k = g.k),
phis AS (SELECT word_idx, word, k, n, round((n + 1.0::DOUBLE) / CAST(sum(n) OVER (PARTITION BY k) + count(*) OVER (PARTITION BY k) AS DOUBLE), 12) AS phi FROM grid)"""
)
SWEEP = (
    STATE
    + f""",
nd AS (SELECT doc_id, [count(*) FILTER (k = 0){"".join(f", count(*) FILTER (k = {t})" for t in range(1, K))}] AS nd FROM z GROUP BY doc_id),
nw AS (SELECT word, [count(*) FILTER (k = 0){"".join(f", count(*) FILTER (k = {t})" for t in range(1, K))}] AS nw FROM z GROUP BY word),
nt AS (SELECT [count(*) FILTER (k = 0){"".join(f", count(*) FILTER (k = {t})" for t in range(1, K))}] AS nt FROM z),
p AS (SELECT z.doc_id, z.word, z.i, [{", ".join(
        f"(nd[{t + 1}] - CAST(k = {t} AS INT) + 1.0::DOUBLE) * (nw[{t + 1}] - CAST(k = {t} AS INT) + 1.0::DOUBLE)"
        f" / (nt[{t + 1}] - CAST(k = {t} AS INT) + CAST((SELECT count(*) FROM vocab) AS DOUBLE))" for t in range(K))}] AS p
      FROM z JOIN nd USING (doc_id) JOIN nw USING (word), nt),
c AS (SELECT doc_id, word, [{", ".join("(" + " + ".join(f"p[{s + 1}]" for s in range(t + 1)) + ")" for t in range(K))}] AS c,
             CAST(CAST('0x' || substr(md5(concat_ws('|', doc_id, word, i, '1')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM p),
drawn AS (SELECT doc_id, CAST(least({K - 1}, len(list_filter(c, lambda x: x < u * c[{K}]))) AS INT) AS k FROM c),
drawn_words AS (SELECT word, CAST(least({K - 1}, len(list_filter(c, lambda x: x < u * c[{K}]))) AS INT) AS k FROM c)"""
)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FIXED = (
    "alldocs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {_quote(t)})" for i, t in DOCUMENTS.items())
    + ") v(doc_id, text))"
)
LINES = (
    FIXED
    + """,
ls AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM alldocs), unnest(range(1, len(l) + 1)) r(i))"""
)


def _licence() -> str:
    trigger = " OR ".join(f"starts_with(line, {_quote(s)})" for s in dict.fromkeys(f[0] for f in LICENCE_FORMS))
    cases = []
    for k, (start, places, same, second, third, points) in enumerate(LICENCE_FORMS):
        goes_on = "(" + " OR ".join(f"substr(l0, {p + 1}, {len(same)}) = {_quote(same)}" for p in places) + ")"
        two, three = f"starts_with(l1, {_quote(second)})", f"starts_with(l2, {_quote(third)})"
        hit = f"starts_with(l0, {_quote(start)})" + (f" AND {goes_on}" if k == 4 else "")
        if k == 0:
            own = f"CAST({goes_on} AS INT) + CAST({two} AS INT) + CAST({three} AS INT)"
        elif points == 2:
            own = f"CASE WHEN NOT {goes_on} THEN 0 WHEN {two} THEN 3 ELSE 1 END"
        else:
            own = f"CASE WHEN NOT {goes_on} THEN 0 WHEN NOT {two} THEN 1 WHEN NOT {three} THEN 2 ELSE 3 END"
        cases.append(f"WHEN {hit} THEN {own}")
    return (
        LINES
        + f""",
hit AS (SELECT doc_id, min(line_no) AS at FROM ls WHERE line_no > 1 AND ({trigger}) GROUP BY doc_id),
three AS (SELECT d.doc_id, coalesce(a.line, '') AS l0, coalesce(b.line, '') AS l1, coalesce(c.line, '') AS l2
          FROM alldocs d LEFT JOIN hit ON hit.doc_id = d.doc_id
          LEFT JOIN ls a ON a.doc_id = d.doc_id AND a.line_no = hit.at
          LEFT JOIN ls b ON b.doc_id = d.doc_id AND b.line_no = hit.at + 1
          LEFT JOIN ls c ON c.doc_id = d.doc_id AND c.line_no = hit.at + 2),
scan AS (SELECT doc_id, CAST(CASE {" ".join(cases)} ELSE 0 END AS INT) AS score FROM three)"""
    )


LICENCE = _licence()


def _ranges(gutenberg: bool) -> str:
    marked = "CASE WHEN n IS NULL THEN 'HOLDER' ELSE array_to_string(l[m + 5 : n - 6], chr(10)) END" if gutenberg else "text"
    return (
        FIXED
        + rf""",
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM alldocs),
nums AS (SELECT *, coalesce(TRY_CAST(regexp_extract(coalesce(l[2], ''), '^\s*([+-]?\d{{1,9}})', 1) AS INT), 0) AS s,
                coalesce(TRY_CAST(regexp_extract(coalesce(l[3], ''), '^\s*([+-]?\d{{1,9}})', 1) AS INT), 0) AS e,
                list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '*** START OF') OR starts_with(l[i], '***START OF'))[1] AS m FROM cut),
marks AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i > m AND (starts_with(l[i], '*** END OF') OR starts_with(l[i], '***END OF')))[1] AS n FROM nums),
ranged AS (SELECT doc_id, CASE WHEN s <> 0 AND e <> 0 THEN 'header' ELSE '{"gutenberg" if gutenberg else "whole"}' END AS mode,
                  CASE WHEN s <> 0 AND e <> 0 THEN array_to_string(l[greatest(s, 1) : e - 1], chr(10)) ELSE {marked} END AS body FROM marks)"""
    )


CELLS = "cells AS (SELECT CAST(vec_id AS INT) AS i, CAST(p - 1 AS INT) AS j, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) r(p))"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _u(*parts: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


SYNTH = f"""weights AS (SELECT [{", ".join(_u("'w1'", str(t)) for t in range(10))}] AS w),
gone AS (SELECT d AS doc_id, [{", ".join(f"CAST(floor({_u(chr(39) + 'd1' + chr(39), 'd', str(i))} * 10) AS INT)" for i in range(1, 6))}] AS gone FROM range(100) r(d)),
own AS (SELECT doc_id, [{", ".join(f"CASE WHEN list_contains(gone, {t}) THEN 0.0::DOUBLE ELSE w[{t + 1}] END" for t in range(10))}] AS o FROM gone, weights),
upto AS (SELECT doc_id, [{", ".join("(" + " + ".join(f"o[{s + 1}]" for s in range(t + 1)) + ")" for t in range(10))}] AS c FROM own),
draws AS (SELECT doc_id, pos, CAST(len(list_filter(c, lambda x: x < {_u("'t1'", "doc_id", "pos")} * c[10])) AS INT) AS topic
          FROM upto, range(10000) r(pos)),
made AS (SELECT doc_id, pos, topic, CAST(topic * 10 + CAST(floor(10 * {_u("'n1'", "doc_id", "pos")}) AS INT) AS VARCHAR) AS word FROM draws)"""


def _roles() -> str:
    return """WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT p, greatest(1, least(p - CAST(round_even(0.6::DOUBLE * p, 0) AS INT), n)) AS d FROM n, range(2, 65) r(p))
SELECT CAST(p AS INT) AS p, CAST(CASE WHEN d < p THEN d ELSE p - 1 END AS INT) AS pd, CAST(CASE WHEN d < p THEN p - d ELSE 1 END AS INT) AS pw FROM r"""


ORACLES: dict[str, str] = {
    "tokens_by_lang": "WITH " + words("tok", "documents", "lang") + " SELECT lang, count(*) AS n_tokens FROM tok GROUP BY lang",
    "doc_terms": f"WITH {TERMS} SELECT * FROM terms",
    "doc_terms_nostop": f"WITH {TERMS} SELECT * FROM terms WHERE word NOT IN ({STOP})",
    "doc_terms_dict": f"WITH {TERMS}, {words('dict', 'benchmark', 'item_id')} SELECT * FROM terms WHERE word IN (SELECT word FROM dict)",
    "doc_totals_rollup": f"WITH {TERMS} SELECT doc_id, count(*) AS unique_words, CAST(sum(cnt) AS BIGINT) AS total_words FROM terms GROUP BY ROLLUP (doc_id)",
    "first_docs_terms": "WITH " + words("tok", "(SELECT * FROM documents ORDER BY doc_id LIMIT 20)", "doc_id") + " SELECT doc_id, word, count(*) AS cnt FROM tok GROUP BY ALL",
    "tf": f"WITH {TFIDF} SELECT doc_id, word, round(tf, 9) AS tf FROM tf",
    "df_idf": f"WITH {TFIDF} SELECT word, df, round(idf, 9) AS idf FROM idf",
    "tfidf": f"WITH {TFIDF} SELECT doc_id, word, cnt, df, round(tfidf, 9) AS tfidf FROM scored",
    "tfidf_top10": f"""WITH {TFIDF}, r AS (SELECT doc_id, word, round(tfidf, 10) AS tfidf FROM scored),
ranked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, {LAST}, word) AS INT) AS rank, word, tfidf FROM r WHERE tfidf > 0)
SELECT * FROM ranked WHERE rank <= 10""",
    "vocab_index": f"WITH {VOCAB} SELECT * FROM vocab",
    "doc_matrix": f"""WITH {VOCAB} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) - 1 AS INT) AS slot, word_idx, cnt
FROM terms JOIN vocab USING (word)""",
    "term_dump": f"WITH {TERMS} SELECT doc_id, CAST(CASE WHEN {LAST} = 0 THEN ascii(word) - 97 ELSE 26 END AS INT) AS bucket, word, cnt FROM terms",
    "vocab_union": f"WITH {TOK}, {words('a', 'conversations', 'conv_id')}, {words('b', 'benchmark', 'item_id')} SELECT word FROM tok UNION SELECT word FROM a UNION SELECT word FROM b",
    "inverted_index": f"""WITH {VOCAB}, m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) - 1 AS slot, word_idx, cnt FROM terms JOIN vocab USING (word))
SELECT word_idx, CAST(sum(cnt) AS BIGINT) AS occ, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc, CAST(sum(slot) AS BIGINT) AS slots FROM m GROUP BY word_idx""",
    "doc_blocks": f"WITH {blocks(7)} SELECT * FROM blocks",
    "doc_serpentine": f"WITH {SERPENTINE} SELECT * FROM dealt",
    "serpentine_load": f"WITH {SERPENTINE} SELECT proc, count(*) AS docs, CAST(sum(size) AS BIGINT) AS bytes FROM dealt GROUP BY proc",
    "role_split": _roles(),
    "word_spread": f"WITH {SPREAD} SELECT * FROM spread",
    "word_placement": f"WITH {PLACED} SELECT * FROM placed",
    "word_bundles": f"WITH {BUNDLES} SELECT * FROM bundles",
    "queue_start": f"""WITH {BUNDLES}, circle AS (SELECT prank, bundle, word_idx, max(bundle) OVER (PARTITION BY prank) AS last FROM heads)
SELECT prank, CAST(min(CASE WHEN word_idx >= prank * (n // 4) OR bundle = last THEN bundle END) AS INT) AS bundle FROM circle, size GROUP BY prank""",
    "local_occ": f"WITH {SPREAD}, {LOCAL} SELECT * FROM occ",
    "occ_matrix": f"WITH {PLACED}, {LOCAL} SELECT prank, word_idx, occ, pw FROM occ JOIN placed USING (word_idx)",
    "condensed_counts": f"WITH {PLACED}, {STATE[len(VOCAB) + 2 :]} SELECT pw, row_in_pw, k, count(*) AS n FROM z JOIN vocab USING (word) JOIN placed USING (word_idx) GROUP BY ALL",
    "workers_used": "SELECT CAST(p AS INT) AS p, CAST(least(p, (SELECT count(*) FROM documents)) AS INT) AS used FROM (SELECT unnest([1, 7, 100, 999, 1000, 1001, 1000000]) AS p)",
    "lda_sweep_topwords": f"""WITH {SWEEP}, nwk AS (SELECT word, k, count(*) AS n FROM drawn_words GROUP BY ALL),
grid AS (SELECT v.word_idx, v.word, g.k, coalesce(nwk.n, 0) AS n
         FROM vocab v CROSS JOIN (SELECT CAST(unnest(range({K})) AS INT) AS k) g LEFT JOIN nwk ON nwk.word = v.word AND nwk.k = g.k),
phis AS (SELECT word_idx, word, k, n, round((n + 1.0::DOUBLE) / CAST(sum(n) OVER (PARTITION BY k) + count(*) OVER (PARTITION BY k) AS DOUBLE), 12) AS phi FROM grid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY phi DESC, word_idx) AS INT) AS rank FROM phis)
SELECT k + 1 AS topic, rank, word, word_idx, n FROM r WHERE rank <= 10 AND k IN (SELECT k FROM r WHERE rank = 1 AND n > 3)""",
    "lda_bundles_mass_word": f"WITH {TERMS} SELECT word, CAST(sum(cnt) AS BIGINT) AS n FROM terms GROUP BY word",
    "lda_bundles_mass_doc": f"WITH {TERMS} SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n FROM terms GROUP BY doc_id",
    "lda_serial_mass": "WITH " + words("tok", "benchmark", "item_id") + " SELECT item_id AS doc_id, count(*) AS n FROM tok GROUP BY ALL",
    "zero_counters": f"WITH {VOCAB} SELECT word_idx, k, CAST(0 AS BIGINT) AS n FROM vocab, (SELECT CAST(unnest(range({K})) AS INT) AS k)",
    "slice_terms": "WITH " + words("tok", "(SELECT * FROM documents ORDER BY doc_id LIMIT 20 OFFSET 10)", "doc_id") + " SELECT doc_id, word, count(*) AS cnt FROM tok GROUP BY ALL",
    "slice_terms_dict": f"""WITH {words("tok", "(SELECT * FROM documents ORDER BY doc_id LIMIT 20 OFFSET 10)", "doc_id")}, {DICTIONARY}
SELECT doc_id, word, count(*) AS cnt FROM tok WHERE word IN (SELECT word FROM listed) GROUP BY ALL""",
    "stop_file_terms": f"WITH {TERMS} SELECT * FROM terms WHERE word NOT IN ('the', 'and', 'of', 'to', 'der')",
    "fixed_vocab": f"WITH {TERMS}, {DICTIONARY}, {FIXED_VOCAB} SELECT * FROM fixed",
    "dict_matrix": f"""WITH {TERMS}, {DICTIONARY}, {FIXED_VOCAB}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) - 1 AS INT) AS slot, word_idx, cnt FROM terms JOIN fixed USING (word)""",
    "ingest_modes": f"""WITH {TERMS}, {DICTIONARY}, every AS (SELECT count(DISTINCT word) AS n_words, CAST(sum(cnt) AS BIGINT) AS n_tokens FROM terms)
SELECT 'serial' AS mode, * FROM every UNION ALL SELECT 'parallel', * FROM every
UNION ALL SELECT 'dictionary', (SELECT count(*) FROM listed), (SELECT CAST(sum(cnt) AS BIGINT) FROM terms WHERE word IN (SELECT word FROM listed))""",
    "index_probe": f"""WITH {VOCAB}, {DICTIONARY}, m AS (SELECT doc_id, word, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) - 1 AS INT) AS slot FROM terms JOIN vocab USING (word))
SELECT word, doc_id, slot FROM m WHERE word IN (SELECT word FROM listed)""",
    "index_matrix": f"""WITH {VOCAB}, {blocks(40)},
m AS MATERIALIZED (SELECT proc, doc_id, word_idx, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY word_idx) - 1 AS slot FROM terms JOIN vocab USING (word) JOIN blocks USING (doc_id)),
w AS (SELECT proc, word_idx, CAST(sum(cnt) AS BIGINT) AS occ FROM m GROUP BY ALL)
SELECT w.proc AS prank, w.word_idx, any_value(w.occ) AS occ, string_agg(CAST(coalesce(m.slot, -1) AS VARCHAR), ',' ORDER BY b.doc_id) AS slots
FROM w JOIN blocks b ON b.proc = w.proc LEFT JOIN m ON m.doc_id = b.doc_id AND m.word_idx = w.word_idx GROUP BY w.proc, w.word_idx""",
    "full_dump": f"""WITH {TFIDF} SELECT doc_id, CAST(CASE WHEN {LAST} = 0 THEN ascii(word) - 97 ELSE 26 END AS INT) AS bucket, word, cnt,
round(tf, 9) AS tf, round(idf, 9) AS idf, round(tfidf, 9) AS tfidf FROM scored""",
    "svd_rebuild": f"WITH {CELLS} SELECT i, j, round(v, 5) + 0.0 AS v FROM cells",
    "svd_u_gram": "SELECT CAST(a AS INT) AS i, CAST(b AS INT) AS j, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) x(a), range(64) y(b)",
    "eigen_rebuild": f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM cells a JOIN cells b ON a.i = b.i GROUP BY ALL",
    "eigen_order": f"WITH {CELLS} SELECT CAST(0 AS BIGINT) AS out_of_order, round(sum(v * v), 4) AS trace FROM cells",
    "eigen_agree": "SELECT CAST(k AS INT) AS k, true AS agree FROM range(25) r(k)",
    "mat_lines": "SELECT CAST(i AS INT) AS i, string_agg(printf('%.6f', (i * 7 + j * 3 - 9) / 4.0::DOUBLE), ' ' ORDER BY j) AS line FROM range(6) a(i), range(5) b(j) GROUP BY i",
    "lda_init_ndk": f"WITH {STATE} SELECT doc_id, k, count(*) AS n FROM z GROUP BY ALL",
    "lda_init_nwk": f"WITH {STATE} SELECT word, k, count(*) AS n FROM z GROUP BY ALL",
    "lda_init_nk": f"WITH {STATE} SELECT k, count(*) AS n FROM z GROUP BY ALL",
    "lda_init_phi": f"WITH {PHI} SELECT word_idx, k, n, phi FROM phis",
    "lda_init_topwords": f"""WITH {PHI}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY phi DESC, word_idx) AS INT) AS rank FROM phis)
SELECT k + 1 AS topic, rank, word, word_idx, n FROM r WHERE rank <= 10 AND k IN (SELECT k FROM r WHERE rank = 1 AND n > 3)""",
    "lda_sync_sweep": f"WITH {SWEEP} SELECT doc_id, k, count(*) AS n FROM drawn GROUP BY ALL",
    "lda_mass_word": f"WITH {TERMS} SELECT word, CAST(sum(cnt) AS BIGINT) AS n FROM terms GROUP BY word",
    "lda_mass_doc": f"WITH {TERMS} SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n FROM terms GROUP BY doc_id",
    "lda_mass_total": f"WITH {TERMS} SELECT CAST(sum(cnt) AS BIGINT) AS n FROM terms",
    "lda_theta": f"""WITH {STATE}, n AS (SELECT doc_id, k, count(*) AS n FROM z GROUP BY ALL),
t AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY doc_id)
SELECT t.doc_id, g.k, round((coalesce(n.n, 0) + 1.0::DOUBLE) / CAST(t.total + {K} AS DOUBLE), 10) AS theta
FROM t CROSS JOIN (SELECT CAST(unnest(range({K})) AS INT) AS k) g LEFT JOIN n ON n.doc_id = t.doc_id AND n.k = g.k""",
    "run_info": f"""WITH {TERMS} SELECT 'block' AS method, 1 AS seed, 10 AS topics, 2 AS iterations, (SELECT count(*) FROM documents) AS n_docs,
count(DISTINCT word) AS n_words, CAST(sum(cnt) AS BIGINT) AS n_tokens FROM terms""",
    "licence_scan": f"WITH {LICENCE} SELECT doc_id, score, score = 3 AS pass FROM scan",
    "licence_summary": f"WITH {LICENCE} SELECT count(*) AS files, count(*) FILTER (score = 3) AS passed FROM scan",
    "titles": f"""WITH {LINES} SELECT d.doc_id, coalesce(t.title, 'doc' || CAST(d.doc_id AS VARCHAR)) AS title
FROM alldocs d LEFT JOIN (SELECT doc_id, max_by(substr(line, 8), line_no) AS title FROM ls WHERE starts_with(line, 'Title:') GROUP BY doc_id) t ON t.doc_id = d.doc_id""",
    "row_range": f"WITH {_ranges(True)} SELECT doc_id, mode, md5(body) AS body_md5 FROM ranged",
    "row_range_terms": f"""WITH {_ranges(False)}, {words("tok", "ranged", "doc_id", "body")}, t AS (SELECT doc_id, word, count(*) AS cnt FROM tok GROUP BY ALL)
SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n, count(*) AS words FROM t GROUP BY doc_id""",
    "mat_transpose": f"WITH {CELLS} SELECT j AS i, i AS j, v FROM cells",
    "mat_mul": f"""WITH {CELLS}, b AS (SELECT CAST(k // 8 AS INT) AS i, CAST(k % 8 AS INT) AS j FROM range(512) r(k)),
m AS (SELECT i, j, CAST((i * 3 + j * 5) % 7 - 3 AS DOUBLE) AS v FROM b)
SELECT c.i, m.j, round(sum(c.v * m.v), 6) + 0.0 AS v FROM cells c JOIN m ON c.j = m.i GROUP BY ALL""",
    "gram_ata": f"WITH {CELLS} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM cells a JOIN cells b ON a.i = b.i GROUP BY ALL",
    "gram_aat": f"WITH {CELLS} SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM cells a JOIN cells b ON a.j = b.j GROUP BY ALL",
    "row_norm": f"WITH {CELLS} SELECT i, j, round(v / sum(v * v) OVER (PARTITION BY i), 6) + 0.0 AS v FROM cells",
    "row_sum_one": f"WITH {CELLS} SELECT i, j, round(abs(v) / sum(abs(v)) OVER (PARTITION BY i), 6) + 0.0 AS v FROM cells",
    "mat_moves": f"""WITH {CELLS}, a AS (SELECT i, CASE j WHEN 3 THEN 9 WHEN 9 THEN 3 ELSE j END AS j, v FROM cells),
b AS (SELECT CASE WHEN i = j AND i = 2 THEN 5 WHEN i = j AND i = 5 THEN 2 ELSE i END AS p, CASE WHEN i = j AND i = 2 THEN 5 WHEN i = j AND i = 5 THEN 2 ELSE j END AS q, v FROM a)
SELECT p AS i, q AS j, CASE WHEN q = 1 THEN -v ELSE v END AS v FROM b""",
    "largest_off_diagonal": f"""WITH {CELLS}, g AS (SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM cells a JOIN cells b ON a.i = b.i WHERE a.j <> b.j GROUP BY ALL)
SELECT i, j FROM g ORDER BY abs(v) DESC, i, j LIMIT 1""",
    "svd_energy": f"WITH {CELLS} SELECT round(sum(v * v), 4) AS energy FROM cells",
    "svd_check": f"WITH {CELLS} SELECT CAST(0 AS BIGINT) AS errors, count(*) AS cells FROM cells",
    "random_matrix": f"SELECT CAST(k // 25 AS INT) AS i, CAST(k % 25 AS INT) AS j, 4 * ({_u('1', 'k // 25', 'k % 25')} - 0.5::DOUBLE) AS v FROM range(1000) r(k)",
    "synth_corpus": f"WITH {SYNTH} SELECT doc_id, topic, word, count(*) AS n FROM made GROUP BY ALL",
    "synth_share": f"WITH {SYNTH} SELECT topic, count(*) / 1000000.0::DOUBLE AS share FROM made GROUP BY topic",
    "page_terms": "WITH " + words("tok", "pages", "page_id", "html") + " SELECT page_id, word, count(*) AS cnt FROM tok GROUP BY ALL",
    "conversation_terms": "WITH " + words("tok", "conversations", "conv_id") + " SELECT conv_id, word, count(*) AS cnt FROM tok GROUP BY ALL",
    "sorted_sizes": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, row_number() OVER (ORDER BY strlen(text) DESC, doc_id) - 1 AS place FROM documents",
}
