"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0). How often each rule votes what on good and on bad documents is
estimated by expectation-maximisation without labels, and a document is kept if its posterior probability of
being good is a half or more. One rule's bad vote need not reject, as all-must-pass filters do.

The votes of a document are a pattern, of which there are at most 3 ** rules however many documents there are.
Expectation-maximisation runs over the pattern counts, as one expression over one row, and each pattern's
posterior is joined back by broadcast. Features, votes, estimation and posteriors are column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8  # a power of two
# Function words of the corpus's languages: fixed values
FUNCTION_WORDS = (
    "the of and to in a is that for with der die und den das ist nicht von mit "
    "la le de les et des un une en el los que y por con"
).split()

# name: (bad if, good if), over the features' columns
RULES = {
    "length": ("n_words < 20", "n_words >= 50"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "lines": ("n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines", "n_dup_lines <= 1 or 10 * n_dup_lines <= n_lines"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "10 * n_repeat_words <= n_words"),
    "capitals": ("10 * n_capitals > 3 * word_chars", "100 * n_capitals <= 15 * word_chars"),
    "shouts": ("10 * n_shouts > n_words", "50 * n_shouts <= n_words"),
    "function_words": ("50 * n_function < n_words", "10 * n_function >= n_words"),
    "stutter": ("5 * n_stutter > n_words", "20 * n_stutter <= n_words"),
}
FEATURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_shouts", "n_function", "n_stutter",
]
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
ROUNDS = 12


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """The words that lie in windows of 8 words found twice or more in the text.

    `words` is bound first: were it an expression of a lower projection, the optimizer could otherwise
    move it into the loops.
    """
    return let(words, _repeat_words)


def _of_halves(width: int):
    """From the hashes of windows of `width` words to those of twice as many; the last `width` mean nothing."""
    return lambda half: F.transform(half, lambda h, i: F.xxhash64(h, F.get(half, i + F.lit(width))))


def _repeat_words(words: Column) -> Column:
    n = F.size(words)
    keys, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:  # a window's hash is that of its halves' hashes: every word is hashed once
        keys, width = let(keys, _of_halves(width)), 2 * width
    keys = F.when(n >= WINDOW, F.slice(keys, 1, n - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))

    def covered(keys):
        ranked = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: _covered(s))

    def _covered(s):
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

        def add(a, p):
            end = p + F.lit(WINDOW)
            return F.struct(end.alias("end"), (a["n"] + end - F.greatest(p, a["end"])).alias("n"))

        return F.aggregate(starts, zero, add, lambda a: a["n"])

    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, FEATURES as long) for every row; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("id"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    words, n = F.col("words"), F.size("words")
    counted = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size("lines"),
        "n_capitals": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_shouts": F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit(""))),
        "n_function": F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS))),
        "n_stutter": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x)),
    }
    rows = split.select("id", *[counted[c].cast("long").alias(c) for c in FEATURES])
    return rows.withColumnRenamed("id", id_col)


def votes() -> Column:
    """The rules' votes as a string, a digit for each rule: 0 bad, 1 abstains, 2 good."""
    return F.concat(*[
        F.expr(f"CASE WHEN {bad} THEN '0' WHEN {good} THEN '2' ELSE '1' END") for bad, good in RULES.values()
    ])


def posteriors(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, good) of a table (pattern, n): the posterior of each pattern, by expectation-maximisation.

    First posteriors: 0.95 without a bad vote, 0.3 with one, 0.05 with more. Counts get one more of each
    vote. Patterns are gathered in one row: there are at most 3 ** rules of them.
    """
    rules = len(RULES)
    # the votes that pattern p casts, as indices into a flat table with three places for each rule
    places = f"transform(sequence(0, {rules - 1}), j -> 3 * j + int(substr(pattern, j + 1, 1)))"
    row = patterns.selectExpr("pattern", "double(n) as n", f"{places} as v").groupBy().agg(
        F.array_sort(F.collect_list(F.struct("pattern", "n", "v"))).alias("pats")
    )
    start = (
        "transform(pats, p -> CASE length(p.pattern) - length(replace(p.pattern, '0', '')) "
        "WHEN 0 THEN 0.95D WHEN 1 THEN 0.3D ELSE 0.05D END)"
    )
    total = "aggregate(pats, 0D, (a, p) -> a + p.n)"
    good = "aggregate(zip_with(pats, q, (p, g) -> p.n * g), 0D, (a, x) -> a + x)"

    def cast(place, weight):
        return f"aggregate(zip_with(pats, q, (p, g) -> IF(array_contains(p.v, {place}), p.n * {weight}, 0D)), 0D, (a, x) -> a + x)"

    # m.prior: log odds of good; m.vote: log likelihood ratio of each rule's votes
    model = (
        f"element_at(transform(array(named_struct('g', {good}, 't', {total})), s -> named_struct("
        "'prior', ln((s.g + 1) / (s.t - s.g + 1)), "
        f"'vote', transform(sequence(0, {3 * rules - 1}), k -> "
        f"ln(({cast('k', 'g')} + 1) / (s.g + 3)) - ln(({cast('k', '(1 - g)')} + 1) / (s.t - s.g + 3))))), 1)"
    )
    expect = (
        f"element_at(transform(array({model}), m -> transform(pats, p -> "
        "1 / (1 + exp(-aggregate(p.v, m.prior, (a, k) -> a + m.vote[k]))))), 1)"
    )
    found = row.selectExpr("pats", f"aggregate(sequence(1, {rounds}), {start}, (q, i) -> {expect}) as q")
    pairs = found.select(F.explode(F.arrays_zip("pats", "q")).alias("x"))
    return pairs.select(F.col("x.pats.pattern").alias("pattern"), F.col("x.q").alias("good"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, FEATURES, base_failed, good, kept): the posterior of being good, and the verdict.

    kept is false where base_failed, else whether good is a half or more.
    """
    rows = materialize(features(docs, id_col, text_col).withColumn("pattern", votes()), "features")
    patterns = rows.groupBy("pattern").agg(F.count("*").alias("n"))
    good = materialize(posteriors(patterns), "posteriors")  # 3 ** rules rows at most
    found = rows.join(F.broadcast(good), "pattern").withColumn("base_failed", F.expr(BASE_FAILED))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= 0.5)).drop("pattern")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is kept. Votes depend on the text alone, so equal texts fare alike.

    The rows are written once with their pattern, so that the features are computed once; the pattern
    counts read that column only, and no text is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = features(docs.select(row.alias("_loom_row"), F.col(text_col).alias("text")), "_loom_row", "text")
    failed = F.expr(f"CASE WHEN {BASE_FAILED} THEN '-' ELSE '' END")
    scored = materialize(scored.select("_loom_row", votes().alias("pattern"), failed.alias("failed")), "scored")
    good = materialize(posteriors(scored.groupBy("pattern").agg(F.count("*").alias("n"))), "posteriors")
    good = F.broadcast(good.where("good >= 0.5").select("pattern"))  # 3 ** rules rows at most
    return scored.where("failed = ''").join(good, "pattern", "left_semi").select("_loom_row.*")


def _sql() -> str:
    rules = list(RULES.values())
    vote = " || ".join(f"CASE WHEN {bad} THEN '0' WHEN {good} THEN '2' ELSE '1' END" for bad, good in rules)
    words = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    steps = []
    for k in range(1, ROUNDS + 1):
        steps.append(f"""
s{k} AS MATERIALIZED (SELECT sum(n * q) AS g, sum(n) AS t FROM pats JOIN q{k - 1} USING (pattern)),
m{k} AS MATERIALIZED (
  SELECT c.place, ln((sum(n * q) + 1) / (any_value(g) + 3)) - ln((sum(n * (1 - q)) + 1) / (any_value(t) - any_value(g) + 3)) AS r
  FROM cast_votes c JOIN q{k - 1} USING (pattern), s{k} GROUP BY c.place),
q{k} AS MATERIALIZED (
  SELECT c.pattern, 1 / (1 + exp(-(any_value(ln((g + 1) / (t - g + 1))) + sum(r)))) AS q
  FROM cast_votes c JOIN m{k} USING (place), s{k} GROUP BY c.pattern)""")
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+7]) AS times FROM spots),
covered AS (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows WHERE times > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM covered GROUP BY doc_id),
features AS MATERIALIZED (
  SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals,
         length(text) - length(replace(text, '!', '')) AS n_shouts,
         len(list_filter(words, lambda w: w IN ({words}))) AS n_function,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter
  FROM split s LEFT JOIN repeats r USING (doc_id)),
voted AS MATERIALIZED (SELECT *, {vote} AS pattern FROM features),
pats AS MATERIALIZED (SELECT pattern, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY pattern),
cast_votes AS MATERIALIZED (
  SELECT pattern, n, 3 * (j - 1) + CAST(substr(pattern, j, 1) AS INTEGER) AS place
  FROM pats, range(1, {len(rules) + 1}) t(j)),
q0 AS MATERIALIZED (
  SELECT pattern, CASE length(pattern) - length(replace(pattern, '0', ''))
         WHEN 0 THEN CAST(0.95 AS DOUBLE) WHEN 1 THEN 0.3 ELSE 0.05 END AS q FROM pats),{",".join(steps)}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND q >= 0.5 AS kept
FROM voted JOIN q{ROUNDS} USING (pattern)
"""


SQL = _sql()
