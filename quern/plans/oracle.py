"""DuckDB SQL that must give the same rows as the queries of the catalog, built from common table expressions."""

from __future__ import annotations

from quern.functions.stem import ADJECTIVAL, DERIVED, FINAL
from quern.operators import lexicon
from quern.sources import samples

NOW = 1_704_067_200

DOCS = f"""
raw_words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
docs AS MATERIALIZED (SELECT doc_id, array_to_string(w[1:8], ' ') AS title, coalesce(array_to_string(w[9:], ' '), '') AS body, {NOW} - (doc_id % 120) * 86400 AS created_at FROM raw_words)"""

FRAGMENTS = """
texts AS (SELECT doc_id, 0 AS field, 0 AS start, title AS text FROM docs UNION ALL SELECT doc_id, 1, strlen(title) + 1, body FROM docs),
cut AS (SELECT doc_id, field, start, string_split_regex(text, '[^\\p{L}]') AS parts FROM texts),
placed AS (SELECT doc_id, field, start, unnest(parts) AS word, generate_subscripts(parts, 1) - 1 AS pos FROM cut),
kept AS MATERIALIZED (
  SELECT doc_id, field, pos, word, start + o AS off FROM (
    SELECT *, coalesce(sum(strlen(word) + 1) OVER (PARTITION BY doc_id, field ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM placed)
  WHERE strlen(word) >= 2)"""


def stem_ctes(source: str, name: str = "stems") -> str:
    """CTEs from a query of distinct lower-cased words (column word) to `name` (word, stem): one CTE for each step."""

    def kinds(x: str) -> str:
        y = f"regexp_replace(regexp_replace({x}, '([aeiou])y', '\\1Y', 'g'), '^y', 'Y')"
        return f"regexp_replace(regexp_replace({y}, '[aeiouy]', '0', 'g'), '[^0]', 'C', 'g')"

    def runs(n: int) -> str:
        return f"len(regexp_extract_all(left(k, length(k) - {n}), 'C+'))"

    def vowel(n: int) -> str:
        return f"contains(left(k, length(k) - {n}), '0')"

    def drop(n: int, put: str = "") -> str:
        return f"(left(s, length(s) - {n}) || '{put}')"

    def table(rules, least: int, first: str = "") -> str:
        return "CASE " + first + " ".join(f"WHEN ends_with(s, '{a}') AND {runs(len(a))} >= {least} THEN {drop(len(a), b)}" for a, b in rules) + " ELSE s END"

    mended = "CASE WHEN regexp_matches(r, '(at|bl|iz)$') THEN r || 'e' WHEN length(r) > 1 AND r[-1] = r[-2] AND NOT regexp_matches(r, '[aeioulsz]$') THEN left(r, length(r) - 1) ELSE r END"
    steps = [
        f"CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN {drop(2)} WHEN ends_with(s, 'ss') THEN s WHEN ends_with(s, 's') THEN {drop(1)} ELSE s END",
        f"CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {runs(3)} > 0 THEN {drop(1)} ELSE s END WHEN ends_with(s, 'ed') THEN CASE WHEN {vowel(2)} THEN {drop(2, '|')} ELSE s END WHEN ends_with(s, 'ing') THEN CASE WHEN {vowel(3)} THEN {drop(3, '|')} ELSE s END ELSE s END",
        f"CASE WHEN ends_with(s, '|') THEN (SELECT {mended} FROM (SELECT left(s, length(s) - 1) AS r)) ELSE s END",
        f"CASE WHEN ends_with(s, 'y') AND {vowel(1)} THEN {drop(1, 'i')} ELSE s END",
        table(DERIVED, 1),
        table(ADJECTIVAL, 1),
        table([(x, "") for x in FINAL], 2, f"WHEN regexp_matches(s, '[st]ion$') AND {runs(3)} > 1 THEN {drop(3)} "),
        f"CASE WHEN ends_with(s, 'e') AND {runs(1)} >= 1 THEN {drop(1)} ELSE s END",
        f"CASE WHEN ends_with(s, 'll') AND {runs(0)} > 1 THEN {drop(1)} ELSE s END",
    ]
    out = [f"{name}_0 AS MATERIALIZED (SELECT DISTINCT word, word AS s, {kinds('word')} AS k FROM ({source}))"]
    for n, step in enumerate(steps, 1):
        out.append(f"{name}_{n} AS MATERIALIZED (SELECT word, s, {kinds('s')} AS k FROM (SELECT word, CASE WHEN length(word) <= 2 THEN s ELSE {step} END AS s FROM {name}_{n - 1}))")
    return ",\n".join([*out, f"{name} AS (SELECT word, s AS stem FROM {name}_{len(steps)})"])


TOKENS = f"""{DOCS},{FRAGMENTS},
{stem_ctes("SELECT lower(word) AS word FROM kept")},
tokens AS MATERIALIZED (SELECT doc_id, field, pos, off, lower(kept.word) AS word, stem FROM kept JOIN stems ON lower(kept.word) = stems.word)"""

POSTINGS = f"""{TOKENS},
runs AS (SELECT *, lead(stem, 1) OVER o AS b, lead(stem, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY doc_id, field ORDER BY pos)),
terms AS (
  SELECT doc_id, field, off, stem AS term, 1 AS tf FROM runs
  UNION ALL SELECT doc_id, field, NULL, stem || '~' || b, CASE field WHEN 0 THEN 3 ELSE 1 END FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, field, NULL, stem || '~' || b || '~' || c, CASE field WHEN 0 THEN 5 ELSE 2 END FROM runs WHERE c IS NOT NULL),
postings AS MATERIALIZED (
  SELECT term, doc_id, coalesce(sum(tf) FILTER (field = 0), 0)::BIGINT AS title_tf, coalesce(sum(tf) FILTER (field = 1), 0)::BIGINT AS body_tf,
         list(off ORDER BY off) FILTER (off IS NOT NULL) AS offs FROM terms GROUP BY 1, 2)"""

STATS = f"""{POSTINGS},
lens AS MATERIALIZED (
  SELECT doc_id, created_at, coalesce(t, 0)::BIGINT AS title_len, coalesce(b, 0)::BIGINT AS body_len
  FROM docs LEFT JOIN (SELECT doc_id, sum(title_tf) AS t, sum(body_tf) AS b FROM postings GROUP BY 1) USING (doc_id)),
corpus AS MATERIALIZED (SELECT count(*) AS n, avg(title_len) AS avg_t, avg(body_len) AS avg_b FROM lens),
dfs AS MATERIALIZED (SELECT term, count(*) AS df, count(*) FILTER (title_tf > 0) AS title_df FROM postings GROUP BY 1)"""

ASKED = f"""
q_cut AS (SELECT item_id AS qid, list_filter(string_split_regex(coalesce(text, ''), '[^\\p{{L}}~]'), lambda x: strlen(x) >= 2) AS l FROM benchmark),
q_words AS MATERIALIZED (SELECT qid, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM q_cut),
{stem_ctes("SELECT lower(word) AS word FROM q_words", "q_stems")},
asked AS MATERIALIZED (SELECT qid, pos, stem AS term FROM q_words JOIN q_stems ON lower(q_words.word) = q_stems.word)"""

AGE = f"(0.3::DOUBLE + 0.7::DOUBLE * exp(-ln(2::DOUBLE) / 30 * greatest({NOW} - created_at, 0) / 86400.0::DOUBLE))"


def _tf(tf: str, length: str, mean: str) -> str:
    return f"CASE WHEN {tf} = 0 THEN 0 ELSE {tf} * 2.5::DOUBLE / ({tf} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / greatest({mean}, 1))) END"


BM25 = f"""{STATS},{ASKED},
parts AS (
  SELECT qid, doc_id, created_at, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (8 * {_tf('title_tf', 'title_len', 'avg_t')} + {_tf('body_tf', 'body_len', 'avg_b')}) AS part
  FROM asked JOIN postings USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), corpus),
bm AS (SELECT qid, doc_id, sum(part) * any_value({AGE}) AS score FROM parts GROUP BY 1, 2),
bm_ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM bm)"""

VECTORS = """
counts AS MATERIALIZED (SELECT doc_id, stem AS term, count(*) AS c FROM tokens GROUP BY 1, 2),
weighed AS (SELECT doc_id, term, (0.5::DOUBLE + 0.5::DOUBLE * c / max(c) OVER (PARTITION BY doc_id)) AS tf FROM counts),
vecs AS MATERIALIZED (SELECT doc_id, term, tf * ln(n::DOUBLE / df) AS weight FROM weighed JOIN dfs USING (term), corpus),
norms AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM vecs GROUP BY 1)"""

COSINE = f"""{VECTORS},
q_counts AS (SELECT qid, term, count(*) AS c FROM asked GROUP BY 1, 2),
q_weighed AS (SELECT qid, term, (0.5::DOUBLE + 0.5::DOUBLE * c / max(c) OVER (PARTITION BY qid)) AS tf FROM q_counts),
q_vecs AS MATERIALIZED (SELECT qid, term, tf * ln(n::DOUBLE / df) AS weight FROM q_weighed JOIN dfs USING (term), corpus),
q_norms AS (SELECT qid, sqrt(sum(weight * weight)) AS norm FROM q_vecs GROUP BY 1),
sims AS (SELECT qid, doc_id, sum(a.weight * b.weight) AS dot FROM q_vecs a JOIN vecs b USING (term) GROUP BY 1, 2),
cosines AS MATERIALIZED (SELECT qid, doc_id, dot / (q.norm * d.norm) AS score FROM sims JOIN q_norms q USING (qid) JOIN norms d USING (doc_id) WHERE q.norm > 0 AND d.norm > 0 AND dot > 0),
cos_ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM cosines)"""

COMPLETIONS = f"""{TOKENS},
tiers AS (
  SELECT lower(title) AS term, 10000 AS weight FROM docs WHERE strlen(title) >= 2
  UNION ALL SELECT stem, 100 * count(*) FROM tokens WHERE field = 0 GROUP BY 1),
completions AS MATERIALIZED (SELECT term, max(weight)::BIGINT AS weight FROM tiers GROUP BY 1)"""

TYPED = """
typed AS (SELECT item_id AS qid, string_split_regex(trim(text), '\\s+') AS w FROM benchmark),
inputs AS MATERIALIZED (SELECT qid, lower(CASE WHEN qid % 2 = 0 THEN left(w[1], 3) ELSE array_to_string(w[1:2], ' ') END) AS p FROM typed)"""

MISSPELT = f"""
m_words AS (SELECT DISTINCT lower(unnest(string_split_regex(coalesce(text, ''), '[^\\p{{L}}]'))) AS w FROM benchmark),
m_bad AS MATERIALIZED (SELECT DISTINCT left(w, 2) || substr(w, 4) AS word FROM m_words WHERE length(w) >= 5),
{stem_ctes("SELECT word FROM m_bad", "m_stems")},
bad AS MATERIALIZED (SELECT word, stem FROM m_stems)"""

TRIGRAM_RANKS = """own AS MATERIALIZED (SELECT DISTINCT stem AS token, unnest(list_distinct(list_transform(range(1, length(stem) + 1), lambda i: substr('$' || stem || '$', i, 3)))) AS g FROM bad),
sizes AS (SELECT token, count(*) AS q FROM own GROUP BY 1),
theirs AS MATERIALIZED (SELECT term, length(term) AS m, unnest(list_transform(range(1, length(term) + 1), lambda i: substr('$' || term || '$', i, 3))) AS g FROM dfs),
shared AS (SELECT token, term, m, count(*) AS both_n FROM own JOIN theirs USING (g) GROUP BY 1, 2, 3),
scored AS MATERIALIZED (SELECT token, term, both_n::DOUBLE / (q + m - both_n) AS j FROM shared JOIN sizes USING (token) WHERE both_n::DOUBLE / (q + m - both_n) >= 0.25),
t_ranked AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY j DESC, term)::INT AS rank FROM scored)"""

TRIGRAMS = f"{STATS},{MISSPELT},{TRIGRAM_RANKS}"


def _narrow(word: str) -> str:
    """Lower-cased letters of several bytes as capitals, which terms don't have: DuckDB's edit distance counts bytes."""
    return f"translate({word}, 'ßäçèéêíñóöüàáâîïôúùûëœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


def _dictionary_words() -> str:
    words = {w.lower() for p in lexicon.default_phrases() for w in p.split()} | {w for h, r in lexicon.default_synonyms().items() for w in (h, *r)}
    return _values([(w,) for w in sorted(words)], "word")


_PAIRS = _values([(h, s) for h, r in lexicon.default_synonyms().items() for s in r], "head, syn")
_PHRASES = _values([(n, p.lower()) for n, p in enumerate(lexicon.default_phrases())], "n, phrase")


def _runs(n: int) -> str:
    joined = " || '~' || ".join(["stem", *(f"lead(stem, {k}) OVER o" for k in range(1, n))])
    return f"WITH {TOKENS} SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, {joined} AS term FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY field, pos)) WHERE term IS NOT NULL GROUP BY 1, 2"


_SAMPLE_DOCS = f"""
docs AS MATERIALIZED ({_values([(n, title, body, NOW - days * 86400) for n, (title, body, days) in enumerate(samples.SAMPLES)], "doc_id, title, body, created_at")})"""

_SYNONYM_CTES = f"""{stem_ctes(_dictionary_words(), "d_stems")}, p AS (SELECT a.stem AS x, b.stem AS y FROM ({_PAIRS}) JOIN d_stems a ON a.word = head JOIN d_stems b ON b.word = syn),
pairs AS (SELECT DISTINCT x AS stem, y AS synonym FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p))"""

_COMPOUNDS = f"""{stem_ctes(_dictionary_words(), "c_stems")},
w_phrase AS (SELECT n, unnest(string_split(phrase, ' ')) AS word, generate_subscripts(string_split(phrase, ' '), 1) AS i FROM ({_PHRASES})),
compounds AS MATERIALIZED (SELECT DISTINCT compound FROM (SELECT n, string_agg(stem, '~' ORDER BY i) AS compound, count(*) AS k FROM w_phrase JOIN c_stems USING (word) GROUP BY 1) WHERE k IN (2, 3))"""


def _phrases(source: str) -> str:
    """SQL for the phrases of queries (qid, raw): places are walked from left to right, for three words first, then for two among what is left."""

    def walk(name: str, size: int, free: str, start: str) -> str:
        term = f"array_to_string(stems[p:p + {size - 1}], '~')"
        hit = f"({free} AND {term} IN (SELECT compound FROM compounds))"
        return f"""{name}(qid, p, stems, used, found) AS (
          SELECT * FROM ({start})
          UNION ALL SELECT qid, CASE WHEN {hit} THEN p + {size} ELSE p + 1 END, stems, CASE WHEN {hit} THEN used || range(p, p + {size}) ELSE used END, CASE WHEN {hit} THEN found || [{term}] ELSE found END
          FROM {name} WHERE p + {size - 1} <= len(stems))"""

    first = "SELECT qid, 1::BIGINT, stems, []::BIGINT[], []::VARCHAR[] FROM stemmed"
    then = "SELECT qid, 1::BIGINT, stems, used, found FROM threes WHERE p + 2 > len(stems)"
    return f"""WITH RECURSIVE raws AS ({source}),
        cut_q AS (SELECT qid, list_filter(string_split_regex(raw, '[^\\p{{L}}]'), lambda x: x <> '') AS l FROM raws),
        q_words AS MATERIALIZED (SELECT qid, lower(unnest(l)) AS word, generate_subscripts(l, 1) AS i FROM cut_q),
        {stem_ctes("SELECT word FROM q_words", "p_stems")}, {_COMPOUNDS},
        stemmed AS MATERIALIZED (SELECT qid, coalesce(list(stem ORDER BY i) FILTER (stem IS NOT NULL), []) AS stems FROM raws LEFT JOIN q_words USING (qid) LEFT JOIN p_stems USING (word) GROUP BY 1),
        {walk("threes", 3, "true", first)},
        {walk("twos", 2, "NOT list_has_any(used, [p, p + 1])", then)}
        SELECT qid::BIGINT AS qid, array_to_string(found, ',') AS phrases FROM twos WHERE p + 1 > len(stems)"""


_PLANTED = f"""SELECT item_id AS qid, array_to_string(w[1:3] || [phrase] || w[4:4] || [lower(phrase)] || w[5:], ' ') AS raw FROM (
  SELECT item_id, string_split(coalesce(text, ''), ' ') AS w, item_id % {len(lexicon.default_phrases())} AS n FROM benchmark) JOIN ({_values(list(enumerate(lexicon.default_phrases())), "n, phrase")}) USING (n)"""

ORACLE = {
    "tokenise": f"WITH {TOKENS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY field, pos) - 1)::INT AS pos, stem AS token FROM tokens",
    "lexemes": f"WITH {TOKENS} SELECT doc_id, stem AS term, count(*) AS n FROM tokens GROUP BY 1, 2",
    "word_stems": f"WITH {TOKENS} SELECT word, stem, count(*) AS n FROM tokens GROUP BY 1, 2",
    "stem": f"WITH {TOKENS} SELECT DISTINCT word, stem FROM tokens",
    "bigrams": _runs(2),
    "trigrams": _runs(3),
    "char_trigrams": f"WITH {DOCS},{FRAGMENTS}, w AS (SELECT DISTINCT lower(word) AS word FROM kept), g AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr('$' || word || '$', i, 3))) AS trigram FROM w) SELECT word, trigram, count(*) AS n FROM g GROUP BY 1, 2",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
    "lead_sentences": f"WITH {DOCS} SELECT doc_id, CASE WHEN regexp_extract(body, '^(?s)([^.!?]*[.!?]){{2}}', 0) = '' THEN body ELSE regexp_extract(body, '^(?s)([^.!?]*[.!?]){{2}}', 0) END AS lead FROM docs",
    "postings": f"WITH {POSTINGS} SELECT term, doc_id, title_tf, body_tf FROM postings",
    "posting_totals": f"WITH {POSTINGS} SELECT term, doc_id, title_tf + body_tf AS total_tf FROM postings",
    "matched_terms": f"""WITH {BM25},
        hit AS (SELECT qid, doc_id, term, min(pos) AS pos FROM asked JOIN postings USING (term) GROUP BY 1, 2, 3)
        SELECT qid, rank, string_agg(term, ',' ORDER BY pos) AS matched_terms FROM bm_ranked JOIN hit USING (qid, doc_id) WHERE rank <= 5 GROUP BY 1, 2""",
    "joined_lexemes": f"""WITH b AS (SELECT item_id AS qid, list_filter(string_split_regex(coalesce(text, ''), '[^\\p{{L}}]'), lambda x: strlen(x) >= 2)[1:8] AS l FROM benchmark),
        w AS MATERIALIZED (SELECT qid, lower(unnest(l)) AS word, generate_subscripts(l, 1) AS i FROM b),
        {stem_ctes("SELECT word FROM w")},
        parts AS (SELECT qid, least(i, 3) + greatest(i - 3, 0) AS i, greatest(i, 3) AS lexeme, stem FROM w JOIN stems USING (word)),
        joined AS (SELECT qid, lexeme, string_agg(stem, '~' ORDER BY i) AS lex FROM parts GROUP BY 1, 2)
        SELECT item_id AS qid, coalesce(string_agg(lex, ',' ORDER BY lexeme), '') AS lexemes FROM benchmark LEFT JOIN joined ON qid = item_id GROUP BY 1""",
    "blend": f"""WITH {BM25},{COSINE}, weights AS (SELECT unnest([0::DOUBLE, 0.01::DOUBLE, 0.4::DOUBLE, 1::DOUBLE]) AS blend),
        fused AS (SELECT blend, qid, doc_id, sum(p) AS score FROM (
          SELECT blend, qid, doc_id, (1 - blend) / (60 + rank) AS p FROM bm_ranked, weights WHERE rank <= 20
          UNION ALL SELECT blend, qid, doc_id, blend / (60 + rank) FROM cos_ranked, weights WHERE blend > 0.01) GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY blend, qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM fused)
        SELECT blend, qid, rank, doc_id, round(score, 5) AS score FROM r WHERE rank <= 10""",
    "positions": f"WITH {POSTINGS} SELECT term, doc_id, array_to_string(offs[1:8], ',') AS positions FROM postings WHERE NOT contains(term, '~')",
    "doc_lengths": f"""WITH {DOCS},{FRAGMENTS}, w AS (SELECT doc_id, count(*) FILTER (field = 0) AS t, count(*) FILTER (field = 1) AS b FROM kept GROUP BY 1)
        SELECT doc_id, coalesce(t + 3 * greatest(t - 1, 0) + 5 * greatest(t - 2, 0), 0)::BIGINT AS title_len, coalesce(b + greatest(b - 1, 0) + 2 * greatest(b - 2, 0), 0)::BIGINT AS body_len FROM docs LEFT JOIN w USING (doc_id)""",
    "corpus_stats": f"WITH {STATS} SELECT n AS total_docs, round(avg_t, 6) AS avg_title_length, round(avg_b, 6) AS avg_body_length FROM corpus",
    "term_df": f"WITH {STATS} SELECT term, df FROM dfs",
    "vocabulary": f"WITH {POSTINGS} SELECT DISTINCT term FROM postings",
    "title_vocabulary": f"WITH {POSTINGS} SELECT DISTINCT term FROM postings WHERE title_tf > 0",
    "idf": f"WITH {STATS} SELECT term, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM dfs, corpus",
    "recency": f"WITH {DOCS} SELECT doc_id, round({AGE}, 6) AS recency FROM docs",
    "bm25": f"WITH {BM25} SELECT qid, doc_id, rank, round(score, 6) AS score FROM bm_ranked WHERE rank <= 10",
    "tfidf": f"WITH {STATS},{VECTORS} SELECT doc_id, term, round(weight, 6) AS weight, round(norm, 6) AS norm FROM vecs JOIN norms USING (doc_id)",
    "cosine": f"WITH {STATS},{ASKED},{COSINE} SELECT qid, doc_id, round(score, 6) AS score FROM cosines",
    "semantic": f"WITH {STATS},{ASKED},{COSINE} SELECT qid, doc_id, rank, round(score, 6) AS score FROM cos_ranked",
    "rrf": f"""WITH {BM25},{COSINE},
        fused AS (SELECT qid, doc_id, sum(p) AS score FROM (SELECT qid, doc_id, 0.6::DOUBLE / (60 + rank) AS p FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT qid, doc_id, 0.4::DOUBLE / (60 + rank) FROM cos_ranked) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM fused)
        SELECT qid, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "completions": f"WITH {COMPLETIONS} SELECT term, weight FROM completions",
    "suggest": f"""WITH {COMPLETIONS},{TYPED},{stem_ctes("SELECT p AS word FROM inputs WHERE NOT contains(p, ' ')", "p_stems")},
        pre AS (SELECT qid, coalesce(stem, p) AS p FROM inputs LEFT JOIN p_stems ON p = word),
        r AS (SELECT qid, term, weight, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term)::INT AS rank FROM pre JOIN completions ON p <> '' AND starts_with(term, p))
        SELECT qid, term, weight, rank FROM r WHERE rank <= 6 AND NOT contains(term, '~')""",
    "stats": f"WITH {STATS} SELECT n AS total_docs, (SELECT count(*) FROM dfs) AS vocab_size, (SELECT count(*) FROM dfs WHERE title_df > 0) AS title_vocab_size, round(avg_t, 2) AS avg_title_length, round(avg_b, 2) AS avg_body_length FROM corpus",
    "p50": "SELECT list_sort(list(us))[len(list(us)) // 2 + 1] AS p50 FROM (SELECT floor(value)::BIGINT AS us FROM events ORDER BY event_id DESC LIMIT 50)",
    "vocab_trigrams": f"""WITH {STATS}, g AS (SELECT term, unnest(list_transform(range(1, length(term) + 1), lambda i: substr('$' || term || '$', i, 3))) AS trigram FROM dfs)
        SELECT trigram, count(*) AS entries, count(DISTINCT term) AS terms FROM g GROUP BY 1""",
    "trigram_best": f"WITH {TRIGRAMS} SELECT token, term, round(j, 6) AS jaccard FROM t_ranked WHERE rank = 1",
    "trigram_suggest": f"WITH {TRIGRAMS} SELECT token, rank, term, round(j, 6) AS jaccard FROM t_ranked WHERE rank <= 5",
    "correct_query": f"""WITH {STATS},
        typed AS MATERIALIZED (SELECT qid, pos, CASE WHEN pos % 4 = 0 AND length(w) >= 5 THEN left(w, 2) || substr(w, 4) ELSE w END AS word FROM (
          SELECT qid, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM (
            SELECT item_id AS qid, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^\\p{{L}}]'), lambda x: strlen(x) >= 2), lambda x: lower(x)) AS l FROM benchmark))),
        {stem_ctes("SELECT word FROM typed", "m_stems")},
        typed_tokens AS MATERIALIZED (SELECT qid, pos, stem AS token FROM typed JOIN m_stems USING (word)),
        bad AS MATERIALIZED (SELECT DISTINCT token AS stem FROM typed_tokens WHERE token NOT IN (SELECT term FROM dfs)),
        {TRIGRAM_RANKS}
        SELECT qid, pos::INT AS pos, t.token, coalesce(r.term, t.token) AS term, r.term IS NOT NULL AS corrected FROM typed_tokens t LEFT JOIN t_ranked r ON t.token = r.token AND rank = 1""",
    "spell_correct": f"""WITH {STATS},{MISSPELT},
        v AS MATERIALIZED (SELECT term, {_narrow('term')} AS t, length(term) AS m FROM dfs),
        b AS MATERIALIZED (SELECT word, stem, {_narrow('word')} AS w, {_narrow('stem')} AS s, length(word) AS n, length(stem) AS k FROM bad),
        sims AS (
          SELECT word, stem, term, greatest(1 - levenshtein(w, t)::DOUBLE / greatest(n, m), 1 - levenshtein(s, t)::DOUBLE / greatest(k, m)) AS sim
          FROM b JOIN v ON m BETWEEN floor(0.78 * k) - 1 AND ceil(n / 0.78) + 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY word, stem ORDER BY sim DESC, term) AS rank FROM sims WHERE sim >= 0.78)
        SELECT word, stem, term, round(sim, 6) AS sim FROM r WHERE rank = 1""",
    "synonyms": f"WITH {_SYNONYM_CTES} SELECT stem, synonym FROM pairs",
    "synonym_expand": f"WITH {POSTINGS.replace(DOCS, _SAMPLE_DOCS)}, {_SYNONYM_CTES} SELECT stem AS term, string_agg(synonym, ',' ORDER BY synonym) AS synonyms FROM pairs WHERE synonym IN (SELECT term FROM postings) GROUP BY 1",
    "phrases": _phrases(_values(list(enumerate(samples.ASKED)), "qid, raw")),
    "phrases_in_texts": _phrases(_PLANTED),
    "phrase_table": f"""WITH {stem_ctes(_dictionary_words())}, w AS (SELECT n, unnest(string_split(phrase, ' ')) AS word, generate_subscripts(string_split(phrase, ' '), 1) AS i FROM ({_PHRASES})),
        c AS (SELECT n, string_agg(stem, '~' ORDER BY i) AS compound, count(*) AS k FROM w JOIN stems USING (word) GROUP BY 1) SELECT DISTINCT compound FROM c WHERE k IN (2, 3)""",
}
