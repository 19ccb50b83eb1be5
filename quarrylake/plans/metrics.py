"""Run evaluation, document metrics, samples, titles and context texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions import markdown as M
from quarrylake.functions import text as T
from quarrylake.operators import blocks as B
from quarrylake.operators import evaluation as E
from quarrylake.plans.checks import markdown_view
from quarrylake.plans.tables import table

#: Weights of severities.
WEIGHTS = {"error": 5, "purchase": 3, "signup": 2, "click": 1, "view": 1}
STRATA = 8
#: Stratum of a question: the function it should be routed to, and whether it names its course.
STRATUM_TRUTH = {"ECONOMY": ("hybrid_course", True), "STANDARD": ("semantic_general", False), "PROMO": ("recursive", True)}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdicts: a user is a document, the type a dimension, the id an epoch; over 30 passes."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stem"), F.col("event_type").alias("dimension"), F.col("event_id").alias("epoch"), (F.col("value") > 30).alias("passed"))


def _run(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    return E.last_epochs(_samples(spark, sf_dir).filter(F.col("epoch") % 2 == rest), ["stem", "dimension"], "epoch", "passed")


def run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's last verdict in each dimension, and whether its epochs disagree."""
    return _run(spark, sf_dir, 0)


def flip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.flip_rates(_run(spark, sf_dir, 0), "dimension")


def paired_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same documents, with an exact test and the noise of one run."""
    now, before = _run(spark, sf_dir, 0), _run(spark, sf_dir, 1)
    return E.paired(now, before, "stem", "dimension", "passed", E.flip_rates(now, "dimension")).withColumn("p_value", F.round("p_value", 9))


def error_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by type, weighed by severity: count, documents, score, rank."""
    weight = F.lit(1)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("dimension") == name, w).otherwise(weight)
    each = _samples(spark, sf_dir).filter("NOT passed").groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stem").alias("n_stems"))
    scored = each.withColumn("score", F.col("n") * weight)
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("n"), "dimension")))  # a row a type


def stage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by stages: a stage is missing, failed, warned, passed or unverified, and the row by its stages."""
    rows = table(spark, sf_dir, "events")
    stages = ("click", "purchase", "view")
    of = lambda s, c: F.count_if((F.col("event_type") == s) & c)
    cells = [E.cell(of(s, F.lit(True)) > 0, of(s, F.col("value") < 0.5), of(s, F.col("value").between(0.5, 4)), of(s, F.col("value") > 20)).alias(s) for s in stages]
    return rows.groupBy("user_id").agg(*cells).withColumn("state", E.row_state(F.array(*stages)))


def failed_check_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks by name with the first stage that names them, most first."""
    failed = _samples(spark, sf_dir).filter("NOT passed").groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.min_by("stem", "epoch").alias("first_stem"))
    return failed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "dimension")))  # a row a check


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown metrics of every document: headers by level, sections without a body, tokens, tables, lists, damage."""
    rows = markdown_view(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("markdown", F.lit("")).alias("c"))
    lines = F.filter(F.split("c", "\n"), lambda x: F.trim(x) != "")
    held = rows.select("doc_id", "c", lines.alias("lines"), M.headings(F.col("c")).alias("heads"))
    is_head = lambda x: x.rlike(r"^#{1,6}\s")
    at_level = lambda n: F.size(F.filter("heads", lambda h: h["level"] == n))
    empty = F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), lambda i: F.coalesce(is_head(F.get("lines", i - 1)) & F.coalesce(is_head(F.get("lines", i)), F.lit(True)), F.lit(False)))
    return held.select(
        "doc_id", F.size("heads").alias("n_headers"), *[at_level(n).alias(f"n_level{n}") for n in (1, 2, 3)], F.size(empty).alias("n_empty"), T.token_estimate(F.col("c")).alias("n_tokens"),
        F.size(F.filter("lines", lambda x: T.has_table(x))).alias("n_table_lines"), F.size(F.filter("lines", lambda x: x.rlike(r"^\s*(?:[-*+]|\d+\.)\s"))).alias("n_list_lines"), F.regexp_count("c", F.lit("&amp;|&lt;|&gt;|�")).alias("n_artifacts"),
    )


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, range and deviation of document metrics."""
    told, _ = E.summary(_sizes(spark, sf_dir), "doc_id", ["size", "lines", "words"])
    return told.select("metric", F.round("mean", 6).alias("mean"), "low", "high", F.round("deviation", 6).alias("deviation"), "n")


def metric_far_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over two sample deviations from a metric's mean."""
    return E.summary(_sizes(spark, sf_dir), "doc_id", ["size", "lines", "words"])[1]


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length("text").alias("size"), F.size(F.split("text", "\n")).alias("lines"), F.size(F.split("text", " ")).alias("words")).filter("size IS NOT NULL")


def filter_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of pages before and after clean-up, and the share that went; none before gives none."""
    before, after = T.token_estimate(F.col("html")), T.token_estimate(T.html_text(F.col("html")))
    rows = table(spark, sf_dir, "pages").select("page_id", before.alias("before"), after.alias("after"))
    return rows.withColumn("reduction", F.when(F.col("before") > 0, (F.col("before") - F.col("after")) * 100.0 / F.col("before")).otherwise(F.lit(0.0)))


def combined_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several batches, the last that holds a question counts: accuracy and means over what is told, by type."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("question"), F.col("event_id").alias("file"), "event_type", "value")
    last = rows.groupBy("question").agg(F.max_by(F.struct("event_type", "value"), "file").alias("r")).select("question", "r.*")
    told = F.col("event_type") != "view"
    return last.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_right"), F.count_if(told).alias("n_cited"), F.round(F.avg(F.when(told, F.col("value"))), 6).alias("mean_cited"), F.count_if(told & (F.col("value") > 80)).alias("n_high"))


def header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of markdown documents by the documents that have them, with their commonest level, from three documents on."""
    rows = markdown_view(table(spark, sf_dir, "documents"))
    each = rows.select("doc_id", F.explode(M.headings(F.col("markdown"))).alias("h")).select("doc_id", T.normalize_header(F.col("h.text")).alias("header"), F.col("h.level").alias("level")).filter("header != ''")
    # a level is counted with its header first, so a header that all documents share is summed before it moves
    by_level = each.groupBy("header", "level").agg(F.count(F.lit(1)).alias("n"))
    mode = by_level.groupBy("header").agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("level"))
    files = each.select("header", "doc_id").distinct().groupBy("header").agg(F.count(F.lit(1)).alias("n_docs")).filter("n_docs >= 3")
    return files.join(mode, "header")


def header_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that two parsers (all lines of one word, all of two or fewer) find in a document: common, only the first's, only the second's."""
    lines = F.split("text", "\n")
    words = lambda x: F.size(F.split(x, " "))
    pick = lambda keep: F.array_distinct(F.transform(F.filter(lines, keep), lambda x: T.normalize_text(x)))
    a, b = pick(lambda x: words(x) == 1), pick(lambda x: (words(x) <= 2) & (F.length(x) % 2 == 0))
    held = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", a.alias("a"), b.alias("b"))
    return held.select("doc_id", F.size(F.array_intersect("a", "b")).alias("n_common"), F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"))


def merged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that messages of a role propose, once each and sorted, and which conversations did."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("role", "conv_id", F.explode(F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3), 1, 3)).alias("word"))
    return rows.groupBy("role", "word").agg(F.min("conv_id").alias("first_conv"), F.count_distinct("conv_id").alias("n_convs"))


def recent_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the newest thousand events that are at most ten days older than the newest."""
    newest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("last"))
    return newest.join(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 10 DAYS")).select("user_id").distinct()  # one row


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STRATA`` documents of each source, in the order of their ids' digests: repeatable, and the same at every partitioning."""
    digest = F.md5(F.col("doc_id").cast("string"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(digest))
    return table(spark, sf_dir, "documents").select("source", "doc_id", rank.alias("pos")).filter(F.col("pos") <= STRATA)


def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A severity for each document, drawn by weight: where its digest falls among the running weights."""
    total = sum(WEIGHTS.values())
    point = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % total
    pick, low = F.lit(None).cast("string"), 0
    for name, w in sorted(WEIGHTS.items()):
        pick = F.when((point >= low) & (point < low + w), name).otherwise(pick)
        low += w
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("category"))


def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest part name that a line of text holds (ties: the smallest key): names meet lines by their words, then whole."""
    names = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("title")).agg(F.min("p_partkey").alias("p_partkey"))
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("About the "), F.element_at(F.array(*map(F.lit, ("cold ring", "red widget", "new gizmo of steel", "nothing"))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.lit(" and a small ring")).alias("line"))
    keyed = names.select("title", "p_partkey", F.get(F.split("title", " "), F.lit(0)).alias("word"))
    met = lines.select("s_suppkey", F.lower("line").alias("line"), F.explode(F.array_distinct(F.split(F.lower("line"), " "))).alias("word")).join(keyed, "word").filter(F.contains("line", F.col("title")))
    return met.groupBy("s_suppkey").agg(F.max_by(F.struct("title", "p_partkey"), F.struct(F.length("title"), -F.col("p_partkey"))).alias("m")).select("s_suppkey", "m.title", "m.p_partkey")


def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different first words of each source's documents."""
    return table(spark, sf_dir, "documents").select("source", F.substring_index("text", " ", 1).alias("header")).filter("header IS NOT NULL").distinct()


def context_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation as numbered sources, first, third and so on, the second last; marks escaped."""
    rows = table(spark, sf_dir, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("rank <= 5")
    n = F.max("rank").over(Window.partitionBy("conv_id"))
    place = F.when(F.col("rank") == 2, n + 1).otherwise(F.col("rank"))
    line = F.concat(F.lit('<source n="'), F.col("rank").cast("string"), F.lit('" role="'), "role", F.lit('">'), T.escape_xml(F.substring(F.coalesce("text", F.lit("")), 1, 40)), F.lit("</source>"))
    told = rows.select("conv_id", F.struct(place.alias("place"), line.alias("line")).alias("s"))
    return told.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("context"))  # five messages at most


def history_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of each conversation, 200 characters each, role first."""
    rows = table(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("back <= 4")
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 200))
    return rows.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n")).alias("digest"))  # four messages at most


def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forms of each page compared: length within bounds, no fewer headings, no fewer links."""
    a, b = F.col("html"), T.html_text(F.col("html"))
    ratio = F.when(F.length(a) > 0, F.length(b) / F.length(a)).otherwise(F.lit(1.0))
    return table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", ratio.between(0.5, 0.99).alias("length_ok"), (F.regexp_count(b, F.lit(r"\*\*\*")) >= F.regexp_count(a, F.lit("<h[1-6]"))).alias("marks_ok"), (F.regexp_count(a, F.lit("<tr")) <= F.regexp_count(b, F.lit(r"\|"))).alias("rows_ok"))


def draft_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each message as a drafted question: too short, no question mark, no role."""
    rows = table(spark, sf_dir, "conversations")
    errors = F.concat_ws("; ", F.when(F.coalesce(F.length(F.trim("text")), F.lit(0)) < 20, "too short"), F.when(~F.coalesce(F.rtrim("text").endswith("?"), F.lit(False)), "question must end with ?"), F.when(F.col("role").isNull(), "role missing"))
    return rows.select("conv_id", "turn", errors.alias("errors"))


def trace_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a user's events summed by day, and the tally of their types."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    each = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "view")]
    return rows.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sum("k").alias("k"), *each, F.count(F.lit(1)).alias("total"))


def metric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered metric of each event type."""
    return B.evaluate(table(spark, sf_dir, "events"), ["event_type"], B.resolve("all", []))


def filter_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names filtered in two steps, with the tokens before and after each."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<thinking>a b</thinking> "), "p_name", F.lit("     end")).alias("text"))
    out = B.apply_filters(rows, "text", B.resolve("thinking, spaces", [], B.FILTERS))
    return out.select("p_partkey", "text", F.explode("filter_tokens").alias("t")).select("p_partkey", "text", "t.name", "t.before", "t.after")


def router_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a router should say of a question drawn from a chunk, by its stratum: the function, and the course where the stratum names one."""
    truth = F.create_map(*[x for name, (function, _) in STRATUM_TRUTH.items() for x in (F.lit(name), F.lit(function))])
    named = [name for name, (_, named) in STRATUM_TRUTH.items() if named]
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(truth, "p_type"), F.lower("p_type")).alias("expected_function"), F.when(F.col("p_type").isin(*named), F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("courses")).select("p_partkey", "expected_function", F.array_join("courses", ",").alias("courses"))


QUERIES = {
    f.__name__: f
    for f in (
        run_fold, flip_rates, paired_exact, error_ranking, stage_ledger, failed_check_histogram, file_metrics, metric_summary, metric_far_values, filter_reduction, combined_batches, header_candidates, header_overlap, merged_proposals,
        recent_cohort, stratified_sample, weighted_choice, title_matches, missing_sections, context_xml, history_context, gate_results, draft_errors, trace_sums, metric_blocks, filter_steps, router_truth,
    )
}

_FOLD = lambda rest, name: f"{name} AS (SELECT user_id AS stem, event_type AS dimension, arg_max(value > 30, event_id) AS passed, count(*) AS n_epochs, min(value > 30) <> max(value > 30) AS flips FROM events WHERE event_id % 2 = {rest} AND value IS NOT NULL GROUP BY ALL)"
_FLIP = "fr AS (SELECT dimension, count(*) FILTER (n_epochs > 1) AS n, avg(flips::INTEGER) FILTER (n_epochs > 1) AS flip_rate FROM a GROUP BY dimension)"
_MD = "d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN len(string_split(x, ' ')) <= 2 THEN repeat('#', 1 + length(x) % 3) || ' ' || x ELSE x END) AS l FROM documents)"
_LONG = "z AS (SELECT doc_id, length(text) AS size, len(string_split(text, chr(10))) AS lines, len(string_split(text, ' ')) AS words FROM documents WHERE text IS NOT NULL), lg AS (UNPIVOT z ON size, lines, words INTO NAME metric VALUE value)"
_CELL = lambda s: f"CASE WHEN count(*) FILTER (event_type = '{s}') = 0 THEN 'missing' WHEN count(*) FILTER (event_type = '{s}' AND value < 0.5) > 0 THEN 'error' WHEN count(*) FILTER (event_type = '{s}' AND value BETWEEN 0.5 AND 4) > 0 THEN 'warn' WHEN count(*) FILTER (event_type = '{s}' AND value > 20) > 0 THEN 'ok' ELSE 'unverified' END AS {s}"
_CASE = "CASE " + " ".join(f"WHEN dimension = '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1 END"
_NORM_L = "trim(regexp_replace(translate(lower(x), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+', ' ', 'g'))"


def _choice() -> str:
    out, low = [], 0
    for name, w in sorted(WEIGHTS.items()):
        out.append(f"WHEN p BETWEEN {low} AND {low + w - 1} THEN '{name}'")
        low += w
    return f"SELECT doc_id, CASE {' '.join(out)} END AS category FROM (SELECT doc_id, ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % {low} AS p FROM documents)"


ORACLES = {
    "run_fold": f"WITH {_FOLD(0, 'a')} SELECT * FROM a",
    "flip_rates": f"WITH {_FOLD(0, 'a')}, {_FLIP} SELECT * FROM fr",
    "paired_exact": f"""WITH {_FOLD(0, 'a')}, {_FOLD(1, 'b')}, {_FLIP}, c AS (SELECT a.dimension, count(*) AS n, count(*) FILTER (a.passed AND NOT b.passed) AS improved, count(*) FILTER (b.passed AND NOT a.passed) AS regressed FROM a JOIN b USING (stem, dimension) GROUP BY a.dimension)
SELECT dimension, c.n, improved, regressed, improved - regressed AS net, CASE WHEN improved + regressed > 0 THEN round(least(1::DOUBLE, 2 * list_sum(list_transform(range(0, least(improved, regressed) + 1), lambda k: exp(lgamma(improved + regressed + 1) - lgamma(k + 1) - lgamma(improved + regressed - k + 1) - (improved + regressed) * ln(2))))), 9) END AS p_value,
  NOT coalesce(abs(improved - regressed) / c.n <= flip_rate, false) AS exceeds FROM c LEFT JOIN fr USING (dimension)""",
    "error_ranking": f"WITH s AS (SELECT event_type AS dimension, count(*) AS n, count(DISTINCT user_id) AS n_stems FROM events WHERE value <= 30 GROUP BY event_type), t AS (SELECT *, n * {_CASE} AS score FROM s) SELECT *, row_number() OVER (ORDER BY score DESC, n DESC, dimension)::INTEGER AS place FROM t",
    "stage_ledger": f"WITH t AS (SELECT user_id, {_CELL('click')}, {_CELL('purchase')}, {_CELL('view')} FROM events GROUP BY user_id) SELECT *, CASE WHEN 'missing' IN (click, purchase, view) THEN 'incomplete' WHEN 'error' IN (click, purchase, view) THEN 'failed' WHEN 'warn' IN (click, purchase, view) THEN 'warned' WHEN 'unverified' IN (click, purchase, view) THEN 'unverified' ELSE 'passed' END AS state FROM t",
    "failed_check_histogram": "WITH s AS (SELECT event_type AS dimension, count(*) AS n, arg_min(user_id, event_id) AS first_stem FROM events WHERE value <= 30 GROUP BY event_type) SELECT *, row_number() OVER (ORDER BY n DESC, dimension)::INTEGER AS place FROM s",
    "file_metrics": f"""WITH {_MD}, e AS (SELECT doc_id, coalesce(array_to_string(l, chr(10) || chr(10)), '') AS c, list_filter(coalesce(l, []), lambda x: trim(x) <> '') AS l FROM d), h AS (SELECT *, list_transform(list_filter(l, lambda x: regexp_matches(x, '^#{{1,6}}\\s')), lambda x: length(regexp_extract(x, '^#+'))) AS lv FROM e)
SELECT doc_id, len(lv)::INTEGER AS n_headers, {", ".join(f"len(list_filter(lv, lambda v: v = {n}))::INTEGER AS n_level{n}" for n in (1, 2, 3))}, len(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#{{1,6}}\\s') AND coalesce(regexp_matches(l[i + 1], '^#{{1,6}}\\s'), true)))::INTEGER AS n_empty, round_even(length(c) / 4.0, 0)::BIGINT AS n_tokens,
  len(list_filter(l, lambda x: regexp_matches(x, '\\|.*\\|')))::INTEGER AS n_table_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*(?:[-*+]|\\d+\\.)\\s')))::INTEGER AS n_list_lines, len(regexp_extract_all(c, '&amp;|&lt;|&gt;|�'))::INTEGER AS n_artifacts FROM h""",
    "metric_summary": f"WITH {_LONG} SELECT metric, round(avg(value), 6) AS mean, min(value)::DOUBLE AS low, max(value)::DOUBLE AS high, round(stddev_samp(value), 6) AS deviation, count(*) AS n FROM lg GROUP BY metric",
    "metric_far_values": f"WITH {_LONG}, s AS (SELECT metric, avg(value) AS m, stddev_samp(value) AS d, count(*) AS n FROM lg GROUP BY metric) SELECT doc_id, metric, value::DOUBLE AS value FROM lg JOIN s USING (metric) WHERE n >= 3 AND d > 0 AND abs(value - m) > 2 * d",
    "combined_batches": "WITH r AS (SELECT event_id % 500 AS q, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id DESC) = 1) SELECT count(*) AS n, count(*) FILTER (value > 50) AS n_right, count(*) FILTER (event_type <> 'view') AS n_cited, round(avg(value) FILTER (event_type <> 'view'), 6) AS mean_cited, count(*) FILTER (event_type <> 'view' AND value > 80) AS n_high FROM r",
    "header_candidates": f"""WITH {_MD}, h AS (SELECT doc_id, unnest(list_filter(coalesce(l, []), lambda x: regexp_matches(x, '^#{{1,6}}\\s'))) AS x FROM d), n AS (SELECT doc_id, length(regexp_extract(x, '^#+')) AS level, {_NORM_L.replace("{|}", "{{|}}")} AS header FROM h),
c AS (SELECT header, level, count(*) AS n FROM n WHERE header <> '' GROUP BY ALL), m AS (SELECT header, level::INTEGER AS level FROM c QUALIFY row_number() OVER (PARTITION BY header ORDER BY n DESC, level) = 1), f AS (SELECT header, count(DISTINCT doc_id) AS n_docs FROM n WHERE header <> '' GROUP BY header HAVING count(DISTINCT doc_id) >= 3)
SELECT header, n_docs, level FROM f JOIN m USING (header)""",
    "header_overlap": f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, list_distinct(list_transform(list_filter(l, lambda x: len(string_split(x, ' ')) = 1), lambda x: {_NORM_L.replace("{|}", "{{|}}")})) AS a, list_distinct(list_transform(list_filter(l, lambda x: len(string_split(x, ' ')) <= 2 AND length(x) % 2 = 0), lambda x: {_NORM_L.replace("{|}", "{{|}}")})) AS b FROM s)
SELECT doc_id, len(list_filter(a, lambda y: list_contains(b, y)))::INTEGER AS n_common, len(list_filter(a, lambda y: NOT list_contains(b, y)))::INTEGER AS only_a, len(list_filter(b, lambda y: NOT list_contains(a, y)))::INTEGER AS only_b FROM t""",
    "merged_proposals": "WITH w AS (SELECT role, conv_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 3)[1:3]) AS word FROM conversations) SELECT role, word, min(conv_id) AS first_conv, count(DISTINCT conv_id) AS n_convs FROM w GROUP BY ALL",
    "recent_cohort": "WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT DISTINCT user_id FROM n WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY",
    "stratified_sample": f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR))::INTEGER AS pos FROM documents QUALIFY pos <= {STRATA}",
    "weighted_choice": _choice(),
    "title_matches": "WITH n AS (SELECT lower(p_name) AS title, min(p_partkey) AS p_partkey FROM part GROUP BY 1), l AS (SELECT s_suppkey, lower('About the ' || ['cold ring', 'red widget', 'new gizmo of steel', 'nothing'][s_suppkey % 4 + 1] || ' and a small ring') AS line FROM supplier) SELECT s_suppkey, title, p_partkey FROM l JOIN n ON contains(line, title) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY length(title) DESC, p_partkey) = 1",
    "missing_sections": "SELECT DISTINCT source, string_split(text, ' ')[1] AS header FROM documents WHERE text IS NOT NULL",
    "context_xml": """WITH r AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations QUALIFY rank <= 5), n AS (SELECT *, CASE WHEN rank = 2 THEN max(rank) OVER (PARTITION BY conv_id) + 1 ELSE rank END AS place FROM r)
SELECT conv_id, string_agg('<source n="' || rank || '" role="' || role || '">' || replace(replace(replace(replace(left(text, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</source>', chr(10) ORDER BY place) AS context FROM n GROUP BY conv_id""",
    "history_context": "WITH r AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || left(coalesce(text, ''), 200), chr(10) ORDER BY turn)) AS digest FROM r GROUP BY conv_id",
    "draft_errors": "SELECT conv_id, turn, concat_ws('; ', CASE WHEN coalesce(length(trim(text)), 0) < 20 THEN 'too short' END, CASE WHEN NOT coalesce(rtrim(text) LIKE '%?', false) THEN 'question must end with ?' END, CASE WHEN role IS NULL THEN 'role missing' END) AS errors FROM conversations",
    "trace_sums": "SELECT user_id, ts::DATE::VARCHAR AS day, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) AS total FROM events GROUP BY ALL",
}


def _page_oracles() -> dict[str, str]:
    from quarrylake.plans.texts import _HTML

    b = f"({_HTML})"
    return {
        "filter_reduction": f"WITH p AS (SELECT page_id, round_even(length(html) / 4.0, 0)::BIGINT AS before, round_even(length({b}) / 4.0, 0)::BIGINT AS after FROM pages) SELECT *, CASE WHEN before > 0 THEN ((before - after) * 100)::DOUBLE / before ELSE 0 END AS reduction FROM p",
        "gate_results": rf"SELECT page_id, CASE WHEN length(html) > 0 THEN length({b}) / length(html) ELSE 1 END BETWEEN 0.5::DOUBLE AND 0.99::DOUBLE AS length_ok, len(regexp_extract_all({b}, '\*\*\*')) >= len(regexp_extract_all(html, '<h[1-6]')) AS marks_ok, len(regexp_extract_all(html, '<tr')) <= len(regexp_extract_all({b}, '\|')) AS rows_ok FROM pages WHERE html IS NOT NULL",
    }


ORACLES |= _page_oracles()
ORACLES |= {
    "metric_blocks": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg((value > 50)::INTEGER), 6) AS share_high FROM events GROUP BY event_type",
    "filter_steps": "WITH t AS (SELECT p_partkey, '<thinking>a b</thinking> ' || p_name || '     end' AS a, p_name || '     end' AS b, p_name || ' end' AS c FROM part) SELECT p_partkey, c AS text, 'thinking' AS name, round_even(length(a) / 4.0, 0)::BIGINT AS before, round_even(length(b) / 4.0, 0)::BIGINT AS after FROM t UNION ALL SELECT p_partkey, c, 'spaces', round_even(length(b) / 4.0, 0)::BIGINT, round_even(length(c) / 4.0, 0)::BIGINT FROM t",
    "router_truth": "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'hybrid_course' WHEN 'STANDARD' THEN 'semantic_general' WHEN 'PROMO' THEN 'recursive' ELSE lower(p_type) END AS expected_function, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_brand ELSE '' END AS courses FROM part",
}
