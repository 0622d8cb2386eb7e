"""DuckDB oracle SQL for every registered query.

Deliberately different in shape from the Spark plans: n-grams come from
``lead()`` over token positions (not array slices), the coverage cut is a
row walk (not a histogram), Katz constants are direct sums over the seen
and unseen sets, and predictions score every vocabulary word of every
context (a dense brute force, affordable on the check-size tables).
Floating results are rounded to 8 places on both sides.
"""

from __future__ import annotations

from glossa.functions.text import word_list_pattern
from glossa.sources.wordlists import profanity_words

SEED, PROP, CUTOFF, D, A, K = 42, 0.99, 0.9, 0.5, 0.4, 10


def _clean(x: str) -> str:
    pat = word_list_pattern(profanity_words())
    e = f"regexp_replace({x}, '[0-9]+', '', 'g')"
    e = f"regexp_replace({e}, '(f|ht)tp(s?)://([^\\n]*)[.][a-z]+[^\\s.]+', ' ', 'g')"
    e = f"regexp_replace({e}, '[@#][^\\s]+', ' ', 'g')"
    e = f"lower({e})"
    e = f"regexp_replace({e}, '[^\\x00-\\x7F]', '', 'g')"
    e = f"regexp_replace({e}, '{pat}', '', 'g')"
    e = f"regexp_replace({e}, '(\\w)-(\\w)', '\\1' || chr(1) || '\\2', 'g')"
    e = f"regexp_replace({e}, '[[:punct:]]+', '', 'g')"
    e = f"replace({e}, chr(1), '-')"
    return f"regexp_replace({e}, '\\s+', ' ', 'g')"


def _draw(slot: str) -> str:
    key = f"md5(concat('{SEED}:', doc_id, ':', line_no))"
    if slot == "split":
        return f"(CAST(concat('0x', substr({key}, 1, 8)) AS BIGINT) / 4294967296.0)"
    return f"(CAST(concat('0x', substr({key}, 9, 8)) AS BIGINT) % 100 + 1)"


BASE = f"""
lines AS (
  SELECT doc_id, line_no, replace(raw, chr(0), '') AS line
  FROM (SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS line_no, unnest(arr) AS raw
        FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents WHERE lang = 'en'))
),
split AS (
  SELECT doc_id, line_no, line, {_draw('split')} < {PROP} AS is_train,
         CAST({_draw('block')} AS INTEGER) AS block
  FROM lines
),
clean AS (
  SELECT doc_id, line_no, is_train, block, {_clean('line')} AS clean FROM split
),
tok AS (
  SELECT doc_id, line_no, is_train, block, CAST(generate_subscripts(t, 1) AS INTEGER) AS pos,
         unnest(t) AS word
  FROM (SELECT doc_id, line_no, is_train, block,
               list_filter(string_split(clean, ' '), lambda x: x <> '') AS t FROM clean)
),
grams AS (
  SELECT doc_id, line_no, is_train, block, pos, word AS w1,
         lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3, lead(word, 3) OVER w AS w4
  FROM tok WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)
),
uni AS (SELECT word, count(*) AS cnt FROM tok WHERE is_train GROUP BY word),
walk AS (
  SELECT cnt, sum(cnt) OVER (ORDER BY cnt DESC, word ROWS UNBOUNDED PRECEDING) AS cum,
         sum(cnt) OVER () AS tot
  FROM uni
),
nb AS (SELECT max(cnt) AS nb FROM walk WHERE cum >= CAST({CUTOFF} AS DOUBLE) * tot),
kept AS (SELECT word, cnt FROM uni WHERE cnt > (SELECT nb FROM nb)),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS idx, word, CAST(cnt AS BIGINT) AS count,
         cnt / (SELECT sum(cnt) FROM kept) AS p
  FROM kept
),
bi_str AS (SELECT w1, w2, count(*) AS cnt FROM grams WHERE is_train AND w2 IS NOT NULL GROUP BY w1, w2),
tri_str AS (SELECT w1, w2, w3, count(*) AS cnt FROM grams WHERE is_train AND w3 IS NOT NULL
            GROUP BY w1, w2, w3),
bigrams AS (
  SELECT a.idx AS wi_1, b.idx AS wi, CAST(s.cnt AS BIGINT) AS c
  FROM bi_str s JOIN vocab a ON a.word = s.w1 JOIN vocab b ON b.word = s.w2 WHERE s.cnt > 1
),
trigrams AS (
  SELECT a.idx AS wi_2, b.idx AS wi_1, c.idx AS wi, CAST(s.cnt AS BIGINT) AS c
  FROM tri_str s JOIN vocab a ON a.word = s.w1 JOIN vocab b ON b.word = s.w2
       JOIN vocab c ON c.word = s.w3 WHERE s.cnt > 1
),
vsize AS (SELECT count(*) AS v FROM vocab),
ctx2 AS (SELECT wi_1, sum(c) AS t2, count(*) AS n2 FROM bigrams GROUP BY wi_1),
ctx3 AS (SELECT wi_2, wi_1, sum(c) AS t3, count(*) AS n3 FROM trigrams GROUP BY wi_2, wi_1),
alpha2 AS (
  SELECT b.wi_1, (any_value(x.t2) - sum(b.c - {D})) / any_value(x.t2) AS alpha2
  FROM bigrams b JOIN ctx2 x USING (wi_1) GROUP BY b.wi_1
),
total AS (SELECT sum(count) AS n FROM vocab),
seen2 AS (SELECT b.wi_1, sum(v.count) / (SELECT n FROM total) AS seen_mass FROM bigrams b JOIN vocab v ON v.idx = b.wi
          GROUP BY b.wi_1)
"""


def half_up_rounds(sql: str) -> str:
    """Rewrite every ``round(x, d)`` as floor(x*10^d + 0.5)/10^d -- the same
    IEEE steps as the Spark side's ``round_half_up``."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        scale = repr(float(10 ** int(sql[comma + 1:k].strip())))
        out.append(sql[i:j] + f"(floor(({half_up_rounds(sql[j + 6:comma])}) * {scale} + 0.5) / {scale})")
        i = k + 1


def with_base(body: str, extra: str = "") -> str:
    return "WITH " + BASE + (("," + extra) if extra else "") + "\n" + body


TEST_TRI = """
test_tri AS (
  SELECT DISTINCT a.idx AS u, b.idx AS v, c.idx AS w
  FROM (SELECT DISTINCT doc_id, line_no, w1, w2, w3 FROM grams WHERE NOT is_train AND w3 IS NOT NULL) g
  LEFT JOIN vocab a ON a.word = g.w1 LEFT JOIN vocab b ON b.word = g.w2 LEFT JOIN vocab c ON c.word = g.w3
)"""

TEST_BI = """
test_bi AS (
  SELECT DISTINCT a.idx AS v, b.idx AS w
  FROM (SELECT DISTINCT w1, w2 FROM grams WHERE NOT is_train AND w2 IS NOT NULL) g
  LEFT JOIN vocab a ON a.word = g.w1 LEFT JOIN vocab b ON b.word = g.w2
)"""

# Dense Katz pieces for a set of contexts ``ctx(u, v)``: every vocabulary
# word is scored, sums over the seen and unseen sets are taken directly, of
# counts (exact in a double) and not of their quotients, so that a value which
# is a half in theory is one here.
DENSE = f"""
dctx_v AS (SELECT DISTINCT v FROM ctx),
q2 AS (
  SELECT d.v, x.idx AS w, x.p, x.count AS cnt,
         CASE WHEN b.c IS NOT NULL THEN (b.c - {D}) / c2.t2 END AS seen_q,
         b.c AS c2, c2.t2
  FROM dctx_v d CROSS JOIN vocab x
  LEFT JOIN bigrams b ON b.wi_1 = d.v AND b.wi = x.idx
  LEFT JOIN ctx2 c2 ON c2.wi_1 = d.v
),
q2b AS (SELECT v, sum(CASE WHEN c2 IS NULL THEN cnt ELSE 0 END) AS unseen FROM q2 GROUP BY v),
q2f AS (
  SELECT q.v, q.w, q.p, q.c2, q.t2, q.cnt, a.alpha2, qb.unseen,
         CASE WHEN q.c2 IS NOT NULL THEN q.seen_q
              WHEN q.t2 IS NULL THEN q.p
              ELSE a.alpha2 * q.p / (qb.unseen / (SELECT n FROM total)) END AS q2
  FROM q2 q JOIN q2b qb USING (v) LEFT JOIN alpha2 a ON a.wi_1 = q.v
),
dense AS (
  SELECT c.u, c.v, q.w, q.p, q.c2, q.t2, q.q2, q.cnt, q.alpha2, q.unseen, t.c AS c3, x3.t3
  FROM ctx c JOIN q2f q ON q.v = c.v
  LEFT JOIN trigrams t ON t.wi_2 = c.u AND t.wi_1 = c.v AND t.wi = q.w
  LEFT JOIN ctx3 x3 ON x3.wi_2 = c.u AND x3.wi_1 = c.v
),
denom3 AS (
  SELECT u, v,
         CASE WHEN any_value(t2) IS NULL THEN sum(CASE WHEN c3 IS NULL THEN cnt ELSE 0 END) / (SELECT n FROM total)
              ELSE sum(CASE WHEN c3 IS NULL AND c2 IS NOT NULL THEN c2 - {D} ELSE 0 END) / any_value(t2)
                   + coalesce(any_value(alpha2) * (sum(CASE WHEN c3 IS NULL AND c2 IS NULL THEN cnt ELSE 0 END)
                                                   / nullif(any_value(unseen), 0)), 0) END AS denom,
         CASE WHEN any_value(t3) IS NULL THEN 1.0
              ELSE (any_value(t3) - sum(CASE WHEN c3 IS NOT NULL THEN c3 - {D} ELSE 0 END)) / any_value(t3) END AS alpha3
  FROM dense GROUP BY u, v
),
scored AS (
  SELECT d.u, d.v, d.w,
         CASE WHEN d.c3 IS NOT NULL THEN d.c3 / d.t3
              WHEN d.c2 IS NOT NULL THEN {A} * (d.c2 / d.t2)
              ELSE {A} * ({A} * d.p) END AS stupid,
         CASE WHEN d.c3 IS NOT NULL THEN (d.c3 - {D}) / d.t3
              ELSE x.alpha3 * d.q2 / x.denom END AS katz
  FROM dense d JOIN denom3 x ON x.u = d.u AND x.v = d.v
)"""

def _phrases(clean: bool) -> str:
    text = _clean("text") if clean else "text"
    return f"""
words_of AS (
  SELECT conv_id, turn, string_split(regexp_replace(lower({text}), ' $', ''), ' ') AS arr FROM conversations
),
phr AS (
  SELECT conv_id, turn, arr[len(arr) - 1] AS w1, arr[len(arr)] AS w2 FROM words_of WHERE len(arr) >= 2
),
penc AS (
  SELECT p.conv_id, p.turn, coalesce(a.idx, 0) AS u, coalesce(b.idx, 0) AS v
  FROM phr p LEFT JOIN vocab a ON a.word = p.w1 LEFT JOIN vocab b ON b.word = p.w2
),
ctx AS (SELECT DISTINCT u, v FROM penc)"""


#: The stop list that ``predict_no_stopwords`` passes: the 50 most frequent words.
STOP = """
stop AS (SELECT idx FROM vocab ORDER BY count DESC, word LIMIT 50)"""


def _percent(x: str) -> str:
    cents = f"CAST(floor({x} * 100.0 * 100.0 + 0.5) AS BIGINT)"
    whole = f"CAST(floor({cents} / 100) AS BIGINT)"
    frac = f"({cents} % 100)"
    return (f"concat(CASE WHEN {frac} = 0 THEN CAST({whole} AS VARCHAR) "
            f"WHEN {frac} % 10 = 0 THEN {whole} || '.' || CAST(CAST({frac} / 10 AS INTEGER) AS VARCHAR) "
            f"ELSE {whole} || '.' || lpad(CAST({frac} AS VARCHAR), 2, '0') END, '%')")


def _predict_sql(score: str, stop: bool, clean: bool = True) -> str:
    excl = "WHERE s.w NOT IN (SELECT idx FROM stop)" if stop else ""
    body = f"""
SELECT p.conv_id, p.turn, r.w AS word_idx, x.word, round(r.prob, 8) AS prob
FROM penc p
JOIN (SELECT u, v, w, prob FROM (
        SELECT s.u, s.v, s.w, s.{score} AS prob,
               rank() OVER (PARTITION BY s.u, s.v ORDER BY s.{score} DESC) AS rk
        FROM scored s {excl}) WHERE rk <= {K}) r ON r.u = p.u AND r.v = p.v
JOIN vocab x ON x.idx = r.w"""
    extra = _phrases(clean) + "," + DENSE + ("," + STOP if stop else "")
    return with_base(body, extra)


def _ngram_sql(n: int) -> str:
    wcols = ["w1", "w2", "w3", "w4"][:n]
    return with_base(f"""
SELECT doc_id, line_no, pos, concat_ws(' ', {', '.join(wcols)}) AS term
FROM grams WHERE {wcols[-1]} IS NOT NULL""")


ACCURACY = f"""
rows_t AS (
  SELECT g.doc_id, g.line_no, a.idx AS u, b.idx AS v, c.idx AS w
  FROM (SELECT DISTINCT doc_id, line_no, w1, w2, w3 FROM grams WHERE NOT is_train AND w3 IS NOT NULL) g
  LEFT JOIN vocab a ON a.word = g.w1 LEFT JOIN vocab b ON b.word = g.w2 LEFT JOIN vocab c ON c.word = g.w3
),
ctx AS (SELECT DISTINCT u, v FROM rows_t WHERE u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL)"""


def _base_until(name: str) -> str:
    return BASE[:BASE.index(f"\n{name} AS (")].rstrip().rstrip(",")


#: All configurations at once: every table carries its sampling level s, cutoff c and filter f.
SWEEP_SIZES = "WITH " + _base_until("uni") + """,
levels AS (SELECT * FROM (VALUES (20, 20), (25, 25), (30, 30), (100, 101)) t(s, lim)),
cuts AS (SELECT * FROM (VALUES (80, CAST(0.8 AS DOUBLE)), (85, CAST(0.85 AS DOUBLE)), (90, CAST(0.9 AS DOUBLE))) t(c, share)),
filters AS (SELECT * FROM (VALUES ('TRUE', 1), ('FALSE', 0)) t(f, least)),
uni_s AS (SELECT s, w1 AS word, count(*) AS cnt FROM grams JOIN levels ON block <= lim WHERE is_train GROUP BY s, w1),
walk_s AS (
  SELECT s, cnt, sum(cnt) OVER (PARTITION BY s ORDER BY cnt DESC, word ROWS UNBOUNDED PRECEDING) AS cum,
         sum(cnt) OVER (PARTITION BY s) AS tot FROM uni_s
),
nb_s AS (SELECT s, c, max(cnt) AS nb FROM walk_s JOIN cuts ON cum >= share * tot GROUP BY s, c),
voc_s AS (SELECT u.s, n.c, u.word FROM uni_s u JOIN nb_s n ON n.s = u.s AND u.cnt > n.nb),
bi_s AS (SELECT s, w1, w2, count(*) AS cnt FROM grams JOIN levels ON block <= lim WHERE is_train AND w2 IS NOT NULL GROUP BY s, w1, w2),
tri_s AS (SELECT s, w1, w2, w3, count(*) AS cnt FROM grams JOIN levels ON block <= lim WHERE is_train AND w3 IS NOT NULL GROUP BY s, w1, w2, w3),
n1 AS (SELECT s, c, count(*) AS n FROM voc_s GROUP BY s, c),
n2 AS (SELECT b.s, x.c, f, count(*) AS n FROM bi_s b JOIN voc_s x ON x.s = b.s AND x.word = b.w1
       JOIN voc_s y ON y.s = b.s AND y.c = x.c AND y.word = b.w2 JOIN filters ON b.cnt > least GROUP BY b.s, x.c, f),
n3 AS (SELECT b.s, x.c, f, count(*) AS n FROM tri_s b JOIN voc_s x ON x.s = b.s AND x.word = b.w1
       JOIN voc_s y ON y.s = b.s AND y.c = x.c AND y.word = b.w2 JOIN voc_s z ON z.s = b.s AND z.c = x.c AND z.word = b.w3
       JOIN filters ON b.cnt > least GROUP BY b.s, x.c, f)
SELECT concat(l.s, '_', cuts.c, '_', filters.f) AS code, concat(l.s, ' ', cuts.c) AS label1, concat(l.s, ' ', filters.f) AS label2,
       concat(cuts.c, ' ', filters.f) AS label3, CAST(coalesce(n1.n, 0) AS BIGINT) AS unigrams,
       CAST(coalesce(n2.n, 0) AS BIGINT) AS bigrams, CAST(coalesce(n3.n, 0) AS BIGINT) AS trigrams
FROM levels l JOIN cuts ON true JOIN filters ON true
LEFT JOIN n1 ON n1.s = l.s AND n1.c = cuts.c
LEFT JOIN n2 ON n2.s = l.s AND n2.c = cuts.c AND n2.f = filters.f
LEFT JOIN n3 ON n3.s = l.s AND n3.c = cuts.c AND n3.f = filters.f"""


def _sweep_accuracy(configs) -> str:
    """Sizes and accuracy (n = 3) of some configurations, each from a model of its own."""
    parts = []
    for label, lim, cutoff, one in configs:
        base = BASE.replace("FROM tok WHERE is_train GROUP BY word", f"FROM tok WHERE is_train AND block <= {lim} GROUP BY word")
        base = base.replace(f"CAST({CUTOFF} AS DOUBLE)", f"CAST({cutoff} AS DOUBLE)")
        base = base.replace("FROM grams WHERE is_train AND", f"FROM grams WHERE is_train AND block <= {lim} AND")
        base = base if one else base.replace("WHERE s.cnt > 1", "WHERE s.cnt > 0")
        cut, flag = round(100 * cutoff), "TRUE" if one else "FALSE"
        parts.append(f"""SELECT * FROM (WITH {base},{ACCURACY},{DENSE}
SELECT '{label}_{cut}_{flag}' AS code, '{label} {cut}' AS label1, '{label} {flag}' AS label2, '{cut} {flag}' AS label3,
       (SELECT count(*) FROM vocab) AS unigrams, (SELECT count(*) FROM bigrams) AS bigrams, (SELECT count(*) FROM trigrams) AS trigrams,
       sum(CASE WHEN rk <= 3 THEN 1 ELSE 0 END) / count(*) AS accuracy
FROM (SELECT r.*, s.rk FROM rows_t r
      LEFT JOIN (SELECT u, v, w, rank() OVER (PARTITION BY u, v ORDER BY stupid DESC) AS rk FROM scored) s
      ON s.u = r.u AND s.v = r.v AND s.w = r.w) j)""")
    return " UNION ALL ".join(parts)


def queries_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["corpus_lines"] = with_base("SELECT doc_id, line_no, line FROM lines")
    q["split_train_test"] = with_base("SELECT doc_id, line_no, is_train FROM split")
    q["block_sample"] = with_base(
        f"SELECT doc_id, line_no, block FROM split WHERE is_train AND block <= {round(0.25 * 101)}")
    q["clean_lines"] = with_base("SELECT doc_id, line_no, clean FROM clean")
    q["tokens"] = with_base("SELECT doc_id, line_no, pos, word FROM tok")
    for n in (2, 3, 4):
        q[f"ngrams_{n}"] = _ngram_sql(n)
    q["doc_term_counts"] = with_base("""
SELECT doc_id, line_no, term, count(*) AS count FROM (
  SELECT doc_id, line_no, w1 AS term FROM grams
  UNION ALL SELECT doc_id, line_no, w1 || ' ' || w2 FROM grams WHERE w2 IS NOT NULL
  UNION ALL SELECT doc_id, line_no, w1 || ' ' || w2 || ' ' || w3 FROM grams WHERE w3 IS NOT NULL)
GROUP BY doc_id, line_no, term""")
    counts = """
SELECT n, term, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT 1 AS n, w1 AS term FROM grams WHERE is_train
  UNION ALL SELECT 2, w1 || ' ' || w2 FROM grams WHERE is_train AND w2 IS NOT NULL
  UNION ALL SELECT 3, w1 || ' ' || w2 || ' ' || w3 FROM grams WHERE is_train AND w3 IS NOT NULL)
GROUP BY n, term"""
    q["ngram_counts"] = with_base(counts)
    q["merge_counts"] = with_base(counts)
    q["ngram_counts_4"] = with_base(counts.replace(")\nGROUP BY", "\n  UNION ALL SELECT 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM grams WHERE is_train AND w4 IS NOT NULL)\nGROUP BY"))
    q["coverage_cutoff"] = with_base(" UNION ALL ".join(
        f"SELECT CAST({c} AS DOUBLE) AS cutoff, CAST(max(cnt) AS BIGINT) AS nb FROM walk "
        f"WHERE cum >= CAST({c} AS DOUBLE) * tot" for c in (0.8, 0.85, 0.9)))
    q["vocabulary"] = with_base("SELECT idx, word, count, p AS prob FROM vocab")
    q["bigram_model"] = with_base("SELECT wi_1, wi, c AS count FROM bigrams")
    q["bigrams_filtered"] = q["bigram_model"]
    q["trigram_model"] = with_base("SELECT wi_2, wi_1, wi, c AS count FROM trigrams")
    q["decode_trigrams"] = with_base("""
SELECT a.word || ' ' || b.word || ' ' || x.word AS term, t.c AS count
FROM trigrams t JOIN vocab a ON a.idx = t.wi_2 JOIN vocab b ON b.idx = t.wi_1 JOIN vocab x ON x.idx = t.wi""")
    q["context_totals_2"] = with_base("""
SELECT c.wi_1, CAST(c.t2 AS BIGINT) AS total, c.n2 AS n_followers, round(a.alpha2, 8) AS alpha
FROM ctx2 c JOIN alpha2 a USING (wi_1)""")
    q["context_totals_3"] = with_base(f"""
SELECT c.wi_2, c.wi_1, CAST(c.t3 AS BIGINT) AS total, c.n3 AS n_followers, round(d.alpha3, 8) AS alpha,
       round(d.denom, 8) AS denom
FROM ctx3 c JOIN denom3 d ON d.u = c.wi_2 AND d.v = c.wi_1""",
                                      "ctx AS (SELECT wi_2 AS u, wi_1 AS v FROM ctx3)," + DENSE)
    q["seen_unseen_mass"] = with_base("""
SELECT s.wi_1, round(s.seen_mass, 8) AS seen_mass,
       round((SELECT sum(count) FROM vocab x WHERE x.idx NOT IN (SELECT wi FROM bigrams b WHERE b.wi_1 = s.wi_1))
             / (SELECT n FROM total), 8) AS unseen_mass
FROM seen2 s""")
    q["model_stats"] = with_base("""
SELECT 1 AS n, CAST(v AS BIGINT) AS observed, pow(v, 1) AS possible, v / pow(v, 1) AS proportion FROM vsize
UNION ALL SELECT 2, (SELECT count(*) FROM bigrams), pow(v, 2), (SELECT count(*) FROM bigrams) / pow(v, 2) FROM vsize
UNION ALL SELECT 3, (SELECT count(*) FROM trigrams), pow(v, 3), (SELECT count(*) FROM trigrams) / pow(v, 3)
FROM vsize""")
    q["top_unigrams"] = with_base("SELECT word AS term, count FROM vocab ORDER BY count DESC, idx LIMIT 20")
    q["top_bigrams"] = with_base("""
SELECT a.word || ' ' || b.word AS term, t.c AS count
FROM (SELECT * FROM bigrams ORDER BY c DESC, wi_1, wi LIMIT 20) t
JOIN vocab a ON a.idx = t.wi_1 JOIN vocab b ON b.idx = t.wi""")
    q["top_trigrams"] = with_base("""
SELECT a.word || ' ' || b.word || ' ' || x.word AS term, t.c AS count
FROM (SELECT * FROM trigrams ORDER BY c DESC, wi_2, wi_1, wi LIMIT 20) t
JOIN vocab a ON a.idx = t.wi_2 JOIN vocab b ON b.idx = t.wi_1 JOIN vocab x ON x.idx = t.wi""")
    q["stupid_bigram"] = with_base(f"""
SELECT t.v AS wi_1, t.w AS wi, round(CASE WHEN b.c IS NOT NULL THEN b.c / c2.t2
                                    WHEN x.p IS NOT NULL THEN {A} * x.p
                                    ELSE 1.0 / (SELECT v FROM vsize) END, 8) AS score
FROM test_bi t LEFT JOIN bigrams b ON b.wi_1 = t.v AND b.wi = t.w
LEFT JOIN ctx2 c2 ON c2.wi_1 = t.v LEFT JOIN vocab x ON x.idx = t.w""", TEST_BI)
    q["stupid_trigram"] = with_base(f"""
SELECT t.u AS wi_2, t.v AS wi_1, t.w AS wi,
       round(CASE WHEN c.c IS NOT NULL THEN c.c / x3.t3
                  WHEN b.c IS NOT NULL THEN {A} * (b.c / c2.t2)
                  WHEN x.p IS NOT NULL THEN {A} * ({A} * x.p)
                  ELSE {A} * (1.0 / (SELECT v FROM vsize)) END, 8) AS score
FROM test_tri t
LEFT JOIN trigrams c ON c.wi_2 = t.u AND c.wi_1 = t.v AND c.wi = t.w
LEFT JOIN ctx3 x3 ON x3.wi_2 = t.u AND x3.wi_1 = t.v
LEFT JOIN bigrams b ON b.wi_1 = t.v AND b.wi = t.w
LEFT JOIN ctx2 c2 ON c2.wi_1 = t.v LEFT JOIN vocab x ON x.idx = t.w""", TEST_TRI)
    q["katz_bigram"] = with_base("""
SELECT t.v AS wi_1, t.w AS wi, round(q.q2, 8) AS prob
FROM test_bi t LEFT JOIN q2f q ON q.v = coalesce(t.v, 0) AND q.w = t.w""",
                                 TEST_BI + ", ctx AS (SELECT DISTINCT 0 AS u, coalesce(v, 0) AS v FROM test_bi),"
                                 + DENSE)
    q["katz_trigram"] = with_base("""
SELECT t.u AS wi_2, t.v AS wi_1, t.w AS wi, round(s.katz, 8) AS prob
FROM test_tri t LEFT JOIN scored s ON s.u = coalesce(t.u, 0) AND s.v = coalesce(t.v, 0) AND s.w = t.w""",
                                  TEST_TRI + ", ctx AS (SELECT DISTINCT coalesce(u, 0) AS u, coalesce(v, 0) AS v "
                                  "FROM test_tri)," + DENSE)
    q["predict_stupid"] = _predict_sql("stupid", False)
    q["predict_katz"] = _predict_sql("katz", False)
    q["predict_no_stopwords"] = _predict_sql("stupid", True)
    fmt = _predict_sql("katz", False).replace(
        "SELECT p.conv_id, p.turn, r.w AS word_idx, x.word, round(r.prob, 8) AS prob",
        "SELECT p.conv_id, p.turn, x.word AS Word, " + _percent("round(r.prob, 8)") + " AS Probability")
    q["predict_formatted"] = fmt
    q["accuracy_top_n"] = with_base("""
SELECT CAST(n AS INTEGER) AS n, CAST(sum(CASE WHEN rk <= n THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       CAST(count(*) AS BIGINT) AS total,
       sum(CASE WHEN rk <= n THEN 1 ELSE 0 END) / count(*) AS accuracy
FROM (SELECT r.*, s.rk FROM rows_t r
      LEFT JOIN (SELECT u, v, w, rank() OVER (PARTITION BY u, v ORDER BY stupid DESC) AS rk FROM scored) s
      ON s.u = r.u AND s.v = r.v AND s.w = r.w) j
JOIN (SELECT 1 AS n UNION ALL SELECT 3 UNION ALL SELECT 5) ns ON true
GROUP BY n""", ACCURACY + "," + DENSE)
    q["perplexity"] = with_base(f"""
SELECT (SELECT CAST(count(DISTINCT word) AS BIGINT) FROM tok WHERE NOT is_train) AS m,
       round(sum(log2(score)), 6) AS sum_log2,
       round(pow(2.0, -sum(log2(score)) / (SELECT count(DISTINCT word) FROM tok WHERE NOT is_train)), 6)
         AS perplexity
FROM (
  SELECT CASE WHEN c.c IS NOT NULL THEN c.c / x3.t3
              WHEN b.c IS NOT NULL THEN {A} * (b.c / c2.t2)
              WHEN x.p IS NOT NULL THEN {A} * ({A} * x.p)
              ELSE {A} * (1.0 / (SELECT v FROM vsize)) END AS score
  FROM rows_t t
  LEFT JOIN trigrams c ON c.wi_2 = t.u AND c.wi_1 = t.v AND c.wi = t.w
  LEFT JOIN ctx3 x3 ON x3.wi_2 = t.u AND x3.wi_1 = t.v
  LEFT JOIN bigrams b ON b.wi_1 = t.v AND b.wi = t.w
  LEFT JOIN ctx2 c2 ON c2.wi_1 = t.v LEFT JOIN vocab x ON x.idx = t.w)""", ACCURACY)
    q["stream_ngram_counts"] = with_base(counts.replace(" WHERE is_train AND", " WHERE").replace(
        " WHERE is_train", ""))
    q["stream_window_counts"] = with_base("""
SELECT CAST(doc_id // 60 AS BIGINT) AS hour, n, term, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT doc_id, 1 AS n, w1 AS term FROM grams
  UNION ALL SELECT doc_id, 2, w1 || ' ' || w2 FROM grams WHERE w2 IS NOT NULL
  UNION ALL SELECT doc_id, 3, w1 || ' ' || w2 || ' ' || w3 FROM grams WHERE w3 IS NOT NULL)
GROUP BY hour, n, term""")
    q["stream_predict_katz"] = q["predict_katz"]
    q["predict_ranked"] = _predict_sql("stupid", False).replace("round(r.prob, 8) AS prob", "CAST(r.rk AS INTEGER) AS rank").replace(
        "SELECT s.u, s.v, s.w, s.stupid AS prob,", "SELECT s.u, s.v, s.w,").replace("SELECT u, v, w, prob FROM (", "SELECT u, v, w, rk FROM (")
    q["file_lines"] = with_base("""
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) - 1 AS BIGINT) AS line_no, line
FROM lines JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""")
    q["predict_raw"] = _predict_sql("stupid", False, clean=False)
    q["predict_status"] = with_base("""
SELECT w.conv_id, w.turn, CAST(len(arr) AS INTEGER) AS n_words, CASE WHEN len(arr) >= 2 THEN 'ok' ELSE 'too_short' END AS status,
       CAST(coalesce(p.u > 0, false) AS INTEGER) + CAST(coalesce(p.v > 0, false) AS INTEGER) AS n_known
FROM words_of w LEFT JOIN penc p ON p.conv_id = w.conv_id AND p.turn = w.turn""", _phrases(True))
    for n, (table, names) in enumerate((("vocab", ()), ("bigrams", ("wi_1", "wi")), ("trigrams", ("wi_2", "wi_1", "wi"))), 1):
        if n == 1:
            q["top250_unigrams"] = with_base("SELECT word AS term, count FROM vocab WHERE count >= 3 ORDER BY count DESC, idx LIMIT 250")
            continue
        joins = " ".join(f"JOIN vocab x{i} ON x{i}.idx = t.{c}" for i, c in enumerate(names))
        q[f"top250_{table}"] = with_base(f"""
SELECT {" || ' ' || ".join(f"x{i}.word" for i in range(n))} AS term, t.c AS count
FROM (SELECT * FROM {table} WHERE c >= 3 ORDER BY c DESC, {', '.join(names)} LIMIT 250) t {joins}""")
    q["csv_roundtrip"] = q["trigram_model"]
    q["model_reloaded"] = with_base("""
SELECT 'vocab' AS "table", NULL AS wi_2, NULL AS wi_1, idx AS wi, count FROM vocab
UNION ALL SELECT 'bigrams', NULL, wi_1, wi, c FROM bigrams
UNION ALL SELECT 'trigrams', wi_2, wi_1, wi, c FROM trigrams""")
    q["grown_model"] = with_base("""
SELECT 1 AS n, word AS term, count FROM vocab
UNION ALL SELECT 2, a.word || ' ' || x.word, t.c FROM bigrams t JOIN vocab a ON a.idx = t.wi_1 JOIN vocab x ON x.idx = t.wi
UNION ALL SELECT 3, a.word || ' ' || b.word || ' ' || x.word, t.c
FROM trigrams t JOIN vocab a ON a.idx = t.wi_2 JOIN vocab b ON b.idx = t.wi_1 JOIN vocab x ON x.idx = t.wi""")
    q["sweep_sizes"] = SWEEP_SIZES
    q["sweep"] = _sweep_accuracy([(label, lim, c, f) for f in (True, False) for c in (0.8, 0.85, 0.9)
                                  for label, lim in (("20", 20), ("25", 25), ("30", 30), ("100", 101))])
    q["sweep_accuracy"] = _sweep_accuracy([("25", 25, 0.8, True), ("100", 101, 0.9, False)])
    q["model_roundtrip"] = with_base("""
SELECT 'vocab' AS "table", CAST(count(*) AS BIGINT) AS rows FROM vocab
UNION ALL SELECT 'bigrams', count(*) FROM bigrams
UNION ALL SELECT 'trigrams', count(*) FROM trigrams""")
    return {k: half_up_rounds(v) for k, v in q.items()}
