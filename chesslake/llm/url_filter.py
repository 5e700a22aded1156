"""Operator 11: URL filter by rules, then by two character language models, in DataFrame functions only.

URLs that a rule judges are the accepted and the rejected ones. Four fifths of their hosts (SHARE_HELD of the hosts' digests are held
out) train a variable-order Markov model of characters each:

* Text: the host in lower case and all that follows it, digits as 0, between a start and an end symbol.
* A string of up to ORDER + 1 symbols is kept in the tree if it makes up SHARE of the symbols of one of the models, so a
  tree holds at most 1 / SHARE strings of each length, whatever the corpus; contexts are as long as the tree goes.
* P(c | h) = (n(hc) + (n(h) - K(h) + k(h)) * P(c | h')) / (n(h) + k(h)) with h' the context without its first symbol, n(hc) for kept hc (else 0),
  K and k the sum and the number of kept followers (interpolated Witten-Bell smoothing); below the empty context 1 / ALPHABET.

A URL's score is the difference of its log-likelihoods over its number of symbols. The threshold is where the share of accepted
URLs above plus that of rejected ones below is largest on the hosts held out (in steps of 1/1000; of equals the nearest to 0; 0 where a kind is missing).

Scoring needs one look-up for a symbol. With B(h) the sum of log(backing-off weight) over h and its shorter contexts, the
log-probability at a place is log P(g) - B(g without its last symbol) for the longest kept g that ends there, plus B of the longest kept context
before it. Both depend on the longest kept string at a place only, so the model is a table of one number a string, read through a
broadcast of at most 2 * (ORDER + 1) / SHARE rows; the sum over places is an aggregation in the task that made them.

Defined cases: a null URL or one without `://` has an empty host, path and text, and no rule; its score is that of the end symbol alone. Of rules of equal
length the one with the longer host counts. Repeated rows each give their row; equal URLs get one verdict; an empty table
gives none; columns other than page_id and url are not read, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, tidied

#: (verdict, host, beginning of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 5
ALPHABET = 256
SHARE = 1 / 20_000
#: First hexadecimal digits of the digests of hosts whose URLs calibrate.
SHARE_HELD = "012"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"
#: Bins of calibration, in thousandths, lie between plus and minus this.
_EDGE = 32_000


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """id, page_id, host, path, rule, ruled (its verdict), held (calibrates) and text of every row."""
    url = F.col("url").cast("string")
    at = F.locate("://", url)
    rows = pages.select("page_id", F.when(at > 0, F.substr(url, at + 3)).otherwise("").alias("rest"))
    rows = rows.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    rows = rows.withColumn("tail", F.substr("rest", F.length("raw") + 1))
    rows = rows.select("page_id", F.translate("raw", _UPPER, _LOWER).alias("host"), F.regexp_extract("tail", "^[^?#]*", 0).alias("path"), "tail")
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    held = F.substring(F.md5(F.col("host").cast("binary")), 1, 1).isin(*SHARE_HELD)
    text = F.translate(F.concat("host", "tail"), "123456789", "000000000")
    return rows.select(F.monotonically_increasing_id().alias("id"), "page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), held.alias("held"), text.alias("text"))


def _strings(text: Column) -> Column:
    """The strings of up to ORDER + 1 symbols that end at each place of a text, from the start symbol on."""
    symbols = F.concat(F.array(F.lit(_START)), F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), F.array(F.lit(_END)))
    return F.transform(symbols, lambda c, i: F.concat(*(F.coalesce(F.get(symbols, i - k), F.lit("")) for k in range(ORDER, 0, -1)), c))


def tree(rows: DataFrame, share: float = SHARE) -> tuple[DataFrame, int, int]:
    """gram, accepted, rejected: how often each kept string stands in the URLs of judged rows, the end symbol included, the start symbol not; and all symbols of both."""
    seen = rows.where("ruled IS NOT NULL").select((F.col("ruled") == "allow").alias("good"), F.explode(_strings(F.col("text"))).alias("gram")).where(F.col("gram") != _START)
    both = lambda df, a, r: df.groupBy("gram").agg(F.sum(a).alias("accepted"), F.sum(r).alias("rejected"))
    whole = both(seen, F.col("good").cast("long"), (~F.col("good")).cast("long"))
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.right(F.col("gram"), n))
    every = materialize(both(whole.select(F.explode(ends).alias("gram"), "accepted", "rejected"), "accepted", "rejected"), "op11-strings")
    total = every.where(F.length("gram") == 1).agg(F.coalesce(F.sum("accepted"), F.lit(0)).alias("a"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("r")).first()
    enough = lambda c, n: (F.col(c) > 0) & (F.col(c) >= share * n)
    return every.where(enough("accepted", total["a"]) | enough("rejected", total["r"])), total["a"], total["r"]


def model(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """gram and value: what the longest kept string at a place adds to the difference of log-likelihoods; the empty string's where none is kept."""
    kept, n_good, n_bad = tree(rows, share)
    kept = materialize(kept, "op11-tree")
    last = F.right("gram", F.lit(1))
    spark = rows.sparkSession
    ends = kept.where(F.col("gram") == _END).select("accepted", "rejected").first() or (0, 0)
    tops = spark.createDataFrame([("", n_good, n_bad), (_START, *ends)], "context string, n_a long, n_r long")
    contexts = tops.unionByName(kept.where((F.length("gram") <= ORDER) & (last != _END)).select(F.col("gram").alias("context"), F.col("accepted").alias("n_a"), F.col("rejected").alias("n_r")))
    follow = kept.groupBy(F.substr("gram", F.lit(1), F.length("gram") - 1).alias("context")).agg(
        F.sum("accepted").alias("k_a"), F.sum("rejected").alias("k_r"), F.count_if(F.col("accepted") > 0).alias("f_a"), F.count_if(F.col("rejected") > 0).alias("f_r")
    )
    own = contexts.join(follow, "context", "left").na.fill(0, ["k_a", "k_r", "f_a", "f_r"])
    weight = lambda x: F.when(F.col(f"n_{x}") > 0, (F.col(f"n_{x}") - F.col(f"k_{x}") + F.col(f"f_{x}")) / (F.col(f"n_{x}") + F.col(f"f_{x}"))).otherwise(1.0)
    below = lambda x: F.col(f"n_{x}") + F.col(f"f_{x}")
    own = materialize(own.select("context", *(weight(x).alias(f"b_{x}") for x in "ar"), *(below(x).alias(f"d_{x}") for x in "ar")), "op11-contexts")
    # the share of a string in its context, and the weight of what is shorter
    share_of = lambda c, x: F.when(F.col(f"d_{x}") > 0, F.col(c) / F.col(f"d_{x}")).otherwise(0.0)
    steps = kept.withColumn("context", F.substr("gram", F.lit(1), F.length("gram") - 1)).join(own, "context").select(F.col("gram").alias("part"), F.struct(F.length("gram").alias("n"), share_of("accepted", "a").alias("a_a"), share_of("rejected", "r").alias("a_r"), "b_a", "b_r").alias("step"))
    parts = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.right(F.col("gram"), n))
    chains = kept.select("gram", F.explode(parts).alias("part")).join(steps, "part").groupBy("gram").agg(F.sort_array(F.collect_list("step")).alias("steps"))  # ORDER + 1 at most
    likely = lambda x: F.log(F.aggregate("steps", F.lit(1.0 / ALPHABET), lambda p, s: s[f"a_{x}"] + s[f"b_{x}"] * p))
    backed = lambda x: F.aggregate("steps", F.lit(0.0), lambda t, s: t + F.log(s[f"b_{x}"]))
    places = chains.select("gram", (likely("a") - backed("a") - likely("r") + backed("r")).alias("u"))
    shorter = F.transform(F.sequence(F.lit(0), F.length("context")), lambda n: F.right(F.col("context"), n))
    heights = own.select("context", F.explode(shorter).alias("part")).join(own.select(F.col("context").alias("part"), (F.log("b_a") - F.log("b_r")).alias("b")), "part").groupBy("context").agg(F.sum("b").alias("w"))
    after = F.when(last == _END, F.lit(None)).otherwise(F.right("gram", F.lit(ORDER)))
    named = places.withColumn("context", after).unionByName(spark.createDataFrame([("", 0.0, ""), (_START, 0.0, _START)], "gram string, u double, context string"))
    return named.join(heights, "context", "left").select("gram", (F.col("u") + F.coalesce("w", F.lit(0.0))).alias("value"))


def scores(rows: DataFrame, values: DataFrame) -> DataFrame:
    """id and score_micro, the difference of log-likelihoods a symbol in millionths, of rows with id and text."""
    none = values.where("gram = ''").select("value").first()["value"]
    places = rows.select("id", F.explode(_strings(F.col("text"))).alias("gram"))
    found = F.lit(none)
    for n in range(1, ORDER + 2):
        # 2 * (ORDER + 1) / SHARE rows at most
        longer = F.broadcast(values.select(F.col("gram").alias(f"g{n}"), F.col("value").alias(f"v{n}")))
        places = places.join(longer, F.right("gram", F.lit(n)) == F.col(f"g{n}"), "left").drop(f"g{n}")
        found = F.coalesce(f"v{n}", found)
    sums = places.groupBy("id").agg(F.sum(found).alias("s"), (F.count(F.lit(1)) - 1).alias("n"))  # the start symbol is not one that is told
    return sums.select("id", F.floor(F.col("s") / F.col("n") * 1e6 + 0.5).cast("long").alias("score_micro"))


def threshold(scored: DataFrame) -> int:
    """Thousandths from which on URLs are accepted, from rows with ruled and score_micro."""
    at = F.greatest(F.lit(-_EDGE), F.least(F.lit(_EDGE), F.floor(F.col("score_micro") / 1000))).cast("long")
    bins = scored.where("ruled IS NOT NULL").groupBy(at.alias("bin")).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") != "allow").alias("r"))
    zero = F.lit(0).cast("long")
    edges = bins.select((F.col("bin") + 1).alias("edge"), "a", "r").union(bins.select("bin", zero, zero)).union(scored.sparkSession.range(1).select(zero, zero, zero))
    up_to = Window.orderBy("edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 2 * _EDGE rows
    below = edges.groupBy("edge").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).select("edge", F.sum("a").over(up_to).alias("a"), F.sum("r").over(up_to).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    all_a, all_r = F.max("a").over(Window.partitionBy()), F.max("r").over(Window.partitionBy())
    told = below.withColumns({"all_a": all_a, "all_r": all_r})
    gain = (whole("all_a") - whole("a")) * whole("all_r") + whole("r") * whole("all_a")
    return told.orderBy(gain.desc(), F.abs("edge"), "edge").select("edge").first()["edge"]


@tidied("op11-scores")
def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, share: float = SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    rows = materialize(judged(pages, rules), "op11-rows")
    values = materialize(model(rows.where("NOT held"), share), "op11-model")
    scored = materialize(rows.drop("text").join(scores(rows, values), "id"), "op11-scores")
    least = 1000 * threshold(scored.where("held"))
    verdict = F.coalesce("ruled", F.when(F.col("score_micro") >= least, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("score_micro") / 1e6).alias("score"))


def _sql() -> str:
    """The same rows in SQL: every symbol's probability by the recursion itself, context by context."""
    rule = ruled = "NULL"
    for verdict, host, path in sorted(RULES, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule, ruled = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {ruled} END"
    orders = range(ORDER + 1)
    joins = "".join(f" LEFT JOIN kept g{k} ON length(gram) > {k} AND g{k}.gram = right(x.gram, {k + 1}) LEFT JOIN contexts c{k} ON length(x.gram) > {k} AND c{k}.context = right(left(x.gram, length(x.gram) - 1), {k})".replace("ON length(gram)", "ON length(x.gram)") for k in orders)
    chance = {x: f"(1.0 / {ALPHABET}::DOUBLE)" for x in ("accepted", "rejected")}
    for x in chance:
        for k in orders:
            n, kept, followers = (f"c{k}.{name}_{x}" for name in ("n", "kept", "followers"))
            chance[x] = f"(CASE WHEN {n} > 0 THEN (coalesce(g{k}.{x}, 0) + ({n} - {kept} + {followers}) * {chance[x]}) / ({n} + {followers})::DOUBLE ELSE {chance[x]} END)"
    return f"""
WITH p AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
j AS (SELECT id, page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, substr(rest, length(raw) + 1) AS tail FROM h),
t AS (SELECT *, {rule} AS rule, {ruled} AS ruled, left(md5(host), 1) IN ({", ".join(f"'{c}'" for c in SHARE_HELD)}) AS held, chr(2) || regexp_replace(host || tail, '[0-9]', '0', 'g') || chr(3) AS s FROM j),
x AS (SELECT id, ruled, held, substr(s, greatest(1, i - {ORDER}), least(i, {ORDER + 1})) AS gram FROM (SELECT *, unnest(range(2, length(s) + 1)) AS i FROM t)),
every AS (SELECT right(gram, n) AS gram, count(*) FILTER (ruled = 'allow') AS accepted, count(*) FILTER (ruled = 'block') AS rejected
  FROM (SELECT *, unnest(range(1, length(gram) + 1)) AS n FROM x WHERE ruled IS NOT NULL AND NOT held) GROUP BY 1),
total AS (SELECT coalesce(sum(accepted), 0) AS accepted, coalesce(sum(rejected), 0) AS rejected FROM every WHERE length(gram) = 1),
kept AS (SELECT every.* FROM every, total WHERE (every.accepted > 0 AND every.accepted >= {SHARE!r}::DOUBLE * total.accepted) OR (every.rejected > 0 AND every.rejected >= {SHARE!r}::DOUBLE * total.rejected)),
n AS (SELECT gram, accepted, rejected FROM kept UNION ALL SELECT '', accepted, rejected FROM total UNION ALL SELECT chr(2), accepted, rejected FROM kept WHERE gram = chr(3)),
contexts AS (SELECT f.context, n.accepted AS n_accepted, n.rejected AS n_rejected, f.* EXCLUDE (context) FROM
  (SELECT left(gram, length(gram) - 1) AS context, sum(accepted) AS kept_accepted, sum(rejected) AS kept_rejected, count(*) FILTER (accepted > 0) AS followers_accepted, count(*) FILTER (rejected > 0) AS followers_rejected FROM kept GROUP BY 1) f
  JOIN n ON n.gram = f.context),
told AS (SELECT x.id, ln({chance["accepted"]}) - ln({chance["rejected"]}) AS d FROM x{joins}),
scored AS (SELECT t.*, m.score_micro FROM t JOIN (SELECT id, CAST(floor(sum(d) / count(*) * 1e6 + 0.5) AS BIGINT) AS score_micro FROM told GROUP BY id) m USING (id)),
bins AS (SELECT greatest(-{_EDGE}, least({_EDGE}, CAST(floor(score_micro / 1000.0) AS BIGINT))) AS bin, ruled FROM scored WHERE held AND ruled IS NOT NULL),
edges AS (SELECT bin AS edge FROM bins UNION SELECT bin + 1 FROM bins UNION SELECT 0),
best AS (SELECT edge FROM (SELECT edge, (SELECT count(*) FROM bins WHERE bin >= edge AND ruled = 'allow')::HUGEINT * (SELECT count(*) FROM bins WHERE ruled = 'block') + (SELECT count(*) FROM bins WHERE bin < edge AND ruled = 'block')::HUGEINT * (SELECT count(*) FROM bins WHERE ruled = 'allow') AS gain FROM edges)
  ORDER BY gain DESC, abs(edge), edge LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score_micro >= 1000 * (SELECT edge FROM best) THEN 'allow' ELSE 'block' END) AS verdict, score_micro / 1e6::DOUBLE AS score FROM scored"""


OP11_SQL = _sql()


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
