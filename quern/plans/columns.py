"""Queries that apply the column functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.catalog import query, table
from quern.functions import dates, numeric, records, text, web
from quern.functions import tables as fixed

WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
LOW_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def on(name, of, key, columns, sql):
    """A query of key and columns over one table."""

    @query(name, f"SELECT {key}, {sql} FROM {of}" if sql else None)
    def run(spark, sf):
        return table(spark, sf, of).select(key, *columns())


# numbers

on("percentage_change", "lineitem", "l_orderkey", lambda: [numeric.percent_change(F.col("l_quantity"), F.col("l_extendedprice")).alias("change"), numeric.direction(F.col("l_quantity"), F.col("l_extendedprice")).alias("direction")], "round((l_extendedprice - l_quantity) / abs(l_quantity) * 100, 4) AS change, CASE WHEN l_extendedprice > l_quantity THEN 'increase' WHEN l_extendedprice < l_quantity THEN 'decrease' ELSE 'no change' END AS direction")
on("round_number", "part", "p_partkey", lambda: [F.round("p_retailprice", 1).alias("rounded"), F.bround(F.col("p_retailprice") / 8, 0).alias("even")], "round(p_retailprice, 1) AS rounded, round_even(p_retailprice / 8, 0) AS even")
on("clamp_value", "part", "p_partkey", lambda: [(c := numeric.clamp(F.col("p_retailprice"), F.lit(1000.0), F.lit(1500.0))).alias("clamped"), (c != F.col("p_retailprice")).alias("was_clamped")], "greatest(1000.0, least(p_retailprice, 1500.0)) AS clamped, greatest(1000.0, least(p_retailprice, 1500.0)) <> p_retailprice AS was_clamped")
_UNIT_SQL = ", ".join(f"({q(a)}, {q(b)}, {c!r}::DOUBLE, {d!r}::DOUBLE, {e!r}::DOUBLE, {f!r}::DOUBLE)" for a, b, c, d, e, f in fixed.UNITS)
_UNIT = "CASE p_partkey % 4 WHEN 0 THEN 'celsius' WHEN 1 THEN ' KM' WHEN 2 THEN 'lbs' ELSE 'feet' END"
_TO = "CASE p_partkey % 4 WHEN 0 THEN 'fahrenheit' WHEN 1 THEN 'miles' WHEN 2 THEN 'parsec' ELSE 'feet' END"


@query("unit_convert", f"""WITH u(f, t, b, m, o, a) AS (VALUES {_UNIT_SQL}), p AS (SELECT p_partkey, p_retailprice AS v, lower(trim({_UNIT})) AS f, lower(trim({_TO})) AS t FROM part)
SELECT p_partkey, CASE WHEN p.f = p.t THEN v ELSE round((v + b) * m / o + a, 4) END AS converted FROM p LEFT JOIN u ON p.f = u.f AND p.t = u.t""")
def unit_convert(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numeric.convert(F.col("p_retailprice"), F.expr(_UNIT), F.expr(_TO)).alias("converted"))


on("calculator", "lineitem", "l_orderkey", lambda: [numeric.formula("l_extendedprice * (1 - l_discount) + sqrt(l_quantity) ** 3 / max(l_tax, 0.013)").alias("result")], "round(l_extendedprice * (1 - l_discount) + power(sqrt(l_quantity), 3) / greatest(l_tax, 0.013), 6) AS result")
on("execute_expression", "part", "p_partkey", lambda: [numeric.formula("abs(p_size - 25) + min(p_retailprice, 1200) % 7").alias("result")], "round(abs(p_size::DOUBLE - 25) + least(p_retailprice, 1200) % 7, 6) AS result")
on("format_number", "part", "p_partkey", lambda: [numeric.formatted(F.col("p_retailprice"), s).alias(s) for s in ("currency", "percent", "comma")], "'$' || format('{:,.2f}', p_retailprice) AS currency, printf('%.2f', p_retailprice * 100) || '%' AS percent, format('{:,.2f}', p_retailprice) AS comma")
on("format_scientific", "part", "p_partkey", lambda: [numeric.formatted(F.col("p_retailprice"), "scientific").alias("scientific")], "printf('%.6e', p_retailprice) AS scientific")
on("number_to_text", "part", "p_partkey", lambda: [text.number_words(F.col("p_size") * 1001).alias("spoken"), text.words_number(text.number_words(F.col("p_size") * 1001)).alias("back")], None)


@query("array_statistics", """SELECT conv_id, count(*) AS n, round(avg(length(text)), 4) AS mean, round(median(length(text)), 4) AS median, round(stddev_samp(length(text)), 4) AS stdev, min(length(text))::DOUBLE AS low, max(length(text))::DOUBLE AS high, round(sum(length(text)), 4)::DOUBLE AS total FROM conversations GROUP BY 1""")
def array_statistics(spark, sf):
    a = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("double")).alias("a"))  # a conversation's turns
    return a.select("conv_id", numeric.array_summary(F.col("a")).alias("s")).select("conv_id", F.col("s.n").cast("long").alias("n"), "s.mean", "s.median", "s.stdev", "s.low", "s.high", "s.total")


# dates

on("format_date", "orders", "o_orderkey", lambda: [dates.styled(F.col("o_orderdate"), s).alias(s) for s in dates.STYLES], "strftime(o_orderdate, '%b %d, %Y') AS short, strftime(o_orderdate, '%B %d, %Y') AS long, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d/%m/%Y') AS eu")
on("add_duration", "orders", "o_orderkey", lambda: [dates.added(F.col("o_orderdate"), 10, 5, 30).alias("later")], "strftime(o_orderdate + INTERVAL 10 DAY + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS later")
on("is_business_day", "orders", "o_orderkey", lambda: [dates.business_day(F.col("o_orderdate")).alias("business"), F.date_format("o_orderdate", "EEEE").alias("day")], "isodow(o_orderdate) <= 5 AS business, strftime(o_orderdate, '%A') AS day")
on("get_weekday", "orders", "o_orderkey", lambda: [F.date_format("o_orderdate", "EEEE").alias("day"), F.weekday("o_orderdate").alias("number")], "strftime(o_orderdate, '%A') AS day, (isodow(o_orderdate) - 1)::INT AS number")
on("next_occurrence", "orders", "o_orderkey", lambda: [(d := dates.next_weekday(F.col("o_orderdate"), "MON")).cast("string").alias("next"), F.datediff(d, "o_orderdate").alias("days")], "(o_orderdate::DATE + (8 - isodow(o_orderdate))::INT)::VARCHAR AS next, (8 - isodow(o_orderdate))::INT AS days")
on("time_since", "orders", "o_orderkey", lambda: [(s := dates.since(F.col("o_orderdate")))["days"].alias("days"), s["hours"].alias("hours"), s["words"].alias("words")], """CASE WHEN s >= 0 THEN s // 86400 END AS days, CASE WHEN s >= 0 THEN s % 86400 // 3600 END AS hours,
  CASE WHEN s >= 0 THEN CASE WHEN w = '' THEN 'just now' ELSE w END END AS words FROM (SELECT *, concat_ws(', ', CASE WHEN d // 365 > 0 THEN (d // 365)::VARCHAR || ' year' || CASE WHEN d // 365 <> 1 THEN 's' ELSE '' END END, CASE WHEN d % 365 // 30 > 0 THEN (d % 365 // 30)::VARCHAR || ' month' || CASE WHEN d % 365 // 30 <> 1 THEN 's' ELSE '' END END,
  CASE WHEN d % 365 % 30 > 0 THEN (d % 365 % 30)::VARCHAR || ' day' || CASE WHEN d % 365 % 30 <> 1 THEN 's' ELSE '' END END, CASE WHEN h > 0 THEN h::VARCHAR || ' hour' || CASE WHEN h <> 1 THEN 's' ELSE '' END END) AS w FROM (SELECT *, s // 86400 AS d, s % 86400 // 3600 AS h FROM (SELECT o_orderkey, date_diff('second', o_orderdate, TIMESTAMP '2026-02-22 12:00:00') AS s FROM orders))) --""")
on("get_current_time", "nation", "n_nationkey", lambda: [F.date_format(dates.clock("jst"), "yyyy-MM-dd HH:mm").alias("jst"), F.date_format(dates.clock("PST"), "yyyy-MM-dd HH:mm EEEE").alias("pst"), F.unix_timestamp(F.lit(dates.CLOCK)).alias("unix")], "'2026-03-15 23:30' AS jst, '2026-03-15 07:30 Sunday' AS pst, epoch(TIMESTAMP '2026-03-15 14:30:00')::BIGINT AS unix")
on("convert_timezone", "events", "event_id", lambda: [dates.moved(F.col("ts"), "utc", "jst").cast("string").alias("tokyo")], "strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN rtrim('.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0'), '0') ELSE '' END AS tokyo")


@query("parse_date", """WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%d %b %Y') END AS s FROM orders)
SELECT o_orderkey, coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%B %d, %Y'), try_strptime(s, '%d-%m-%Y'), try_strptime(s, '%d %b %Y'))::DATE::VARCHAR AS iso, year(d)::INT AS y, month(d)::INT AS m, day(d)::INT AS day FROM t""")
def parse_date(spark, sf):
    styles = ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM dd, yyyy", "dd-MM-yyyy", "dd MMM yyyy")
    s = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(styles)])
    o = table(spark, sf, "orders").select("o_orderkey", dates.parsed(s).alias("d"))
    return o.select("o_orderkey", F.col("d").cast("string").alias("iso"), F.year("d").alias("y"), F.month("d").alias("m"), F.dayofmonth("d").alias("day"))


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _dated(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, "l_orderkey")


@query("business_days_between", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate::DATE >= o_orderdate::DATE THEN (SELECT count(*) FROM range(1, 1 + (l_shipdate::DATE - o_orderdate::DATE)) t(i) WHERE isodow(o_orderdate::DATE + i::INT) <= 5)::INT END AS days FROM {_LINES}""")
def business_days_between(spark, sf):
    return _dated(spark, sf).select("l_orderkey", "l_linenumber", dates.business_days(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"))


@query("calculate_date_diff", f"""SELECT l_orderkey, l_linenumber, n AS days, round(n / 7, 1) AS weeks, round(n / 30.44, 1) AS months, round(n / 365.25, 2) AS years, before AS first_is_before FROM (SELECT l_orderkey, l_linenumber, abs(l_shipdate::DATE - o_orderdate::DATE)::INT AS n, o_orderdate < l_shipdate AS before FROM {_LINES})""")
def calculate_date_diff(spark, sf):
    return _dated(spark, sf).select("l_orderkey", "l_linenumber", dates.difference(F.col("o_orderdate"), F.col("l_shipdate")).alias("d")).select("l_orderkey", "l_linenumber", "d.*")


# text


def T():
    return F.col("text")


on("word_count", "documents", "doc_id", lambda: [text.white_words(T()).alias("words"), F.length(T()).alias("characters"), text.sentence_ends(T()).alias("sentences")], r"len(list_filter(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::INT AS words, length(text)::INT AS characters, len(regexp_extract_all(text, '[^.!?]*[.!?]'))::INT AS sentences")
on("tokenize_words", "documents", "doc_id", lambda: [F.size(w := text.words(T())).alias("n"), F.md5(F.array_join(w, " ")).alias("h"), F.size(text.characters(T())).alias("chars")], f"len({WORDS})::INT AS n, md5(array_to_string({WORDS}, ' ')) AS h, length(text)::INT AS chars")
on("tokenize_sentences", "documents", "doc_id", lambda: [F.size(s := text.sentences(T())).alias("n"), F.md5(F.array_join(s, "␞")).alias("h")], r"len(string_split(m, '␞'))::INT AS n, md5(m) AS h FROM (SELECT doc_id, regexp_replace(trim(text, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1␞', 'g') AS m FROM documents) --")
on("summarize_text", "documents", "doc_id", lambda: [(s := text.summary(T(), 3)).alias("summary"), F.round(F.try_divide(F.length(s), F.length(T())), 2).alias("ratio")], r"s AS summary, round(length(s) / nullif(n, 0), 2) AS ratio FROM (SELECT doc_id, length(text) AS n, array_to_string(list_slice(string_split(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1␞', 'g'), '␞'), 1, 3), ' ') AS s FROM documents) --")
on("text_statistics", "documents", "doc_id", lambda: [(s := text.statistics(T()))["word_count"].alias("word_count"), s["sentence_count"].alias("sentence_count"), s["avg_word_length"].alias("avg_word_length"), s["reading_seconds"].cast("long").alias("reading_seconds")], rf"n::INT AS word_count, e::INT AS sentence_count, CASE WHEN n > 0 THEN round((c / n)::DECIMAL(18, 10), 2)::DOUBLE ELSE 0.0 END AS avg_word_length, ceil(n / 238 * 60)::BIGINT AS reading_seconds FROM (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS c, CASE WHEN trim(text, ' ') = '' THEN 0 ELSE greatest(len(regexp_split_to_array(trim(text, ' '), '[.!?]+')) - 1, 1) END AS e FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)) --")
on("mask_pii", "conversations", "conv_id", lambda: ["turn", text.masked(T()).alias("masked")], r"turn, regexp_replace(regexp_replace(regexp_replace(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[SSN]', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[EMAIL]', 'g'), '\+?[0-9][0-9\s\-()]{7,}[0-9]', '[PHONE]', 'g') AS masked")
on("mask_pii_found", "conversations", "conv_id", lambda: ["turn", F.array_join(F.concat(text.found(T(), text.SSN), text.found(T(), text.EMAIL)), ",").alias("found")], r"turn, array_to_string(list_concat(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'), regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+')), ',') AS found")
on("extract_entities", "documents", "doc_id", lambda: [F.size(e := text.entities(T())).alias("n"), F.size(F.filter(e, lambda x: x["type"] == "email")).alias("emails"), F.size(F.filter(e, lambda x: x["type"] == "capitalized_phrase")).alias("phrases")], None)
on("extract_numbers", "documents", "doc_id", lambda: [F.size(n := text.numbers(T())).alias("n"), F.round(F.aggregate(n, F.lit(0.0), lambda s, x: s + x), 2).alias("total")], r"len(x)::INT AS n, round(coalesce(list_sum(list_transform(x, lambda v: replace(v, ',', '')::DOUBLE)), 0), 2) AS total FROM (SELECT doc_id, regexp_extract_all(text, '-?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|-?[0-9]+(?:\.[0-9]+)?') AS x FROM documents) --")
on("truncate_text", "documents", "doc_id", lambda: [text.truncated(T(), 60).alias("short"), (F.length(T()) > 60).alias("cut")], "CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 57) || '...' END AS short, length(text) > 60 AS cut")
on("string_replace", "documents", "doc_id", lambda: [F.md5(F.replace(T(), F.lit("the"), F.lit("THE"))).alias("h"), text.occurrences(T(), "the").alias("n")], "md5(replace(text, 'the', 'THE')) AS h, ((length(text) - length(replace(text, 'the', ''))) / 3)::INT AS n")
on("regex_match", "documents", "doc_id", lambda: [F.regexp_count(T(), F.lit(r"[A-Z][a-z]+ing")).alias("n"), F.get(text.found(T(), r"[A-Z][a-z]+ing"), F.lit(0)).alias("first")], r"len(regexp_extract_all(text, '[A-Z][a-z]+ing'))::INT AS n, regexp_extract_all(text, '[A-Z][a-z]+ing')[1] AS first")
on("split_text", "documents", "doc_id", lambda: [F.size(p := F.split(T(), r"\Q. \E", -1)).alias("n"), F.get(p, F.lit(0)).alias("first")], "len(string_split(text, '. '))::INT AS n, string_split(text, '. ')[1] AS first")
on("join_texts", "pages", "page_id", lambda: [F.concat_ws(" / ", F.col("page_id").cast("string"), web.host(F.col("url"))).alias("joined")], r"concat_ws(' / ', page_id::VARCHAR, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1))) AS joined")
on("case_convert", "part", "p_partkey", lambda: [F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), text.snake(F.col("p_name")).alias("snake"), text.camel(F.col("p_name")).alias("camel"), text.title(F.col("p_name")).alias("title")], r"""upper(p_name) AS up, lower(p_type) AS low, lower(regexp_replace(regexp_replace(regexp_replace(trim(p_name), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[\s-]+', '_', 'g'), '_+', '_', 'g')) AS snake,
  array_to_string(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[\s_-]+'), lambda w: w <> ''), lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), '') AS camel, array_to_string(list_transform(regexp_extract_all(lower(p_name), '\p{L}+|[^\p{L}]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS title""")
on("slugify", "part", "p_partkey", lambda: [text.slug(F.concat(F.lit(" Çafé & "), "p_name", F.lit(" — "), "p_type")).alias("slug")], r"trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(replace(' Çafé & ' || p_name || ' — ' || p_type, 'Ç', 'C'), 'é', 'e'), '—', '')), '[^a-z0-9_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug")
on("spell_check", "conversations", "conv_id", lambda: ["turn", text.misspelled(F.concat(T(), F.lit(" Teh recieve untill"))).alias("errors"), F.right(text.spelling(F.concat(T(), F.lit(" Teh recieve untill"))), F.lit(17)).alias("tail")], rf"turn, len(list_filter(regexp_extract_all(lower(text || ' Teh recieve untill'), '[\p{{L}}\p{{N}}_]+'), lambda w: list_contains({listed(fixed.MISSPELLINGS)}, w)))::INT AS errors, 'The receive until' AS tail")


def _best(scores: dict[str, str]) -> tuple[str, str]:
    top = f"greatest({', '.join(scores.values())})"
    return "CASE " + " ".join(f"WHEN {s} = {top} THEN {q(n)}" for n, s in scores.items()) + " END", top


_LANG = {n: f"len(list_intersect(w, {listed(m.split())}))" for n, m in fixed.LANGUAGES.items()}
on("detect_language", "documents", "doc_id", lambda: [(d := text.language(T()))["language"].alias("language"), d["confidence"].alias("confidence")], f"{_best(_LANG)[0]} AS language, round(coalesce({_best(_LANG)[1]} / nullif({' + '.join(_LANG.values())}, 0), 0), 2) AS confidence FROM (SELECT doc_id, {LOW_WORDS} AS w FROM documents) --")
on("sentiment_analysis", "documents", "doc_id", lambda: [(s := text.sentiment(T()))["label"].alias("label"), s["confidence"].alias("confidence")], f"CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN p + n > 0 THEN round(0.5 + abs(p - n) / ((p + n) * 2), 2) ELSE 0.5 END AS confidence FROM (SELECT doc_id, len(list_intersect(w, {listed(fixed.POSITIVE)})) AS p, len(list_intersect(w, {listed(fixed.NEGATIVE)})) AS n FROM (SELECT doc_id, {LOW_WORDS} AS w FROM documents)) --")
CATEGORIES = ["the license", "der die das", "contact mail"]
_CATS = {c: f"(len(list_intersect(w, {listed(sorted(set(c.split())))})) + CASE WHEN contains(t, {q(c)}) THEN 3 ELSE 0 END)" for c in CATEGORIES}
on("classify_text", "documents", "doc_id", lambda: [(c := text.category(T(), CATEGORIES))["category"].alias("category"), c["confidence"].alias("confidence")], f"{_best(_CATS)[0]} AS category, round({_best(_CATS)[1]} / greatest({' + '.join(_CATS.values())}, 1), 3) AS confidence FROM (SELECT doc_id, lower(text) AS t, {LOW_WORDS} AS w FROM documents) --")


@query("keyword_extract", rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b[a-z]{{2,}}\b')) AS word, generate_subscripts(regexp_extract_all(lower(text), '\b[a-z]{{2,}}\b'), 1) AS pos FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE NOT list_contains({listed(fixed.STOPWORDS)}, word) GROUP BY ALL)
SELECT doc_id, word, rank, round(n / max(n) OVER (PARTITION BY doc_id), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) QUALIFY rank <= 5""")
def keyword_extract(spark, sf):
    counted = table(spark, sf, "documents").select("doc_id", text.keyword_counts(F.lower("text")).alias("top"))
    top = counted.select("doc_id", F.get("top", F.lit(0))["n"].alias("most"), F.posexplode("top").alias("rank", "k"))
    return top.select("doc_id", "k.word", (F.col("rank") + 1).cast("long").alias("rank"), F.round(F.col("k.n") / F.col("most"), 4).alias("score"))


def _pairs(spark, sf):
    """Benchmark items and the documents of the same number: pairs known beforehand, no search."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("a"))
    return b.join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("b")), "doc_id")


_A, _B = (rf"list_distinct(regexp_extract_all(lower({c}.text), '[\p{{L}}\p{{N}}_]+'))" for c in "ab")
_PAIRS = f"(SELECT item_id AS doc_id, {_A} AS x, {_B} AS y FROM benchmark a JOIN documents b ON item_id = doc_id)"


@query("text_similarity", f"SELECT doc_id, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 4) END AS jaccard FROM {_PAIRS}")
def text_similarity(spark, sf):
    return _pairs(spark, sf).select("doc_id", F.round(text.overlap(F.col("a"), F.col("b")), 4).alias("jaccard"))


@query("compare_texts", f"SELECT doc_id, len(list_intersect(x, y))::INT AS common, (len(x) - len(list_intersect(x, y)))::INT AS only_a, (len(y) - len(list_intersect(x, y)))::INT AS only_b, list_slice(list_sort(list_intersect(x, y)), 1, 20) AS sample FROM {_PAIRS}")
def compare_texts(spark, sf):
    p = _pairs(spark, sf).select("doc_id", text.word_set(F.col("a")).alias("x"), text.word_set(F.col("b")).alias("y"))
    both = F.array_intersect("x", "y")
    return p.select("doc_id", F.size(both).alias("common"), F.size(F.array_except("x", "y")).alias("only_a"), F.size(F.array_except("y", "x")).alias("only_b"), F.slice(F.array_sort(both), 1, 20).alias("sample"))


# web


def U():
    return F.col("url")


_PARTS = r"'^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
on("url_parse", "pages", "page_id", lambda: [web.parts(U())[c].alias(c) for c in ("scheme", "netloc", "path", "query", "fragment")], f"lower(regexp_extract(url, {_PARTS}, 1)) AS scheme, regexp_extract(url, {_PARTS}, 2) AS netloc, regexp_extract(url, {_PARTS}, 3) AS path, regexp_extract(url, {_PARTS}, 4) AS query, regexp_extract(url, {_PARTS}, 5) AS fragment")
on("extract_domain", "pages", "page_id", lambda: [web.domain(U())[c].alias(c) for c in ("subdomain", "domain", "tld")], r"array_to_string(list_slice(p, 1, len(p) - 2), '.') AS subdomain, CASE WHEN len(p) >= 2 THEN p[-2] ELSE p[-1] END AS domain, CASE WHEN len(p) >= 2 THEN p[-1] ELSE '' END AS tld FROM (SELECT page_id, string_split(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS p FROM pages) --")
on("encode_url", "pages", "page_id", lambda: [(e := web.percent_encoded(F.concat(U(), F.lit(" ~*é+")))).alias("encoded"), (web.percent_decoded(e) == F.concat(U(), F.lit(" ~*é+"))).alias("same")], "url_encode(url || ' ~*é+') AS encoded, true AS same")
on("generate_url", "pages", "page_id", lambda: [web.built(F.concat(F.lit("https://"), web.host(U()), F.lit("/")), F.lit("item"), {"id": F.col("page_id"), "q": F.lit("a b")}).alias("built")], r"'https://' || lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)) || '/item?id=' || page_id::VARCHAR || '&q=a+b' AS built")


def H():
    return F.col("html")


on("parse_html", "pages", "page_id", lambda: [web.html_title(H()).alias("title"), web.link_count(H()).alias("links"), F.md5(web.html_text(H())).alias("h")], r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\s'))::INT AS links, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h")


@query("extract_links", r"""WITH e AS (SELECT page_id, list_concat(regexp_extract_all(t, 'https?://[^\s<>"'')\]]+'), regexp_extract_all(t, '(?i)href=["'']([^"'']+)["'']', 1)) AS x FROM (SELECT page_id, html || ' see ' || url || '.' AS t FROM pages))
SELECT page_id, len(list_distinct(k))::INT AS n, list_sort(list_distinct(k)) AS links FROM (SELECT page_id, list_filter(list_transform(x, lambda u: regexp_replace(u, '[.,;:!?]+$', '')), lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://')) AS k FROM e)""")
def extract_links(spark, sf):
    found = web.links(F.concat("html", F.lit(" see "), "url", F.lit(".")))
    return table(spark, sf, "pages").select("page_id", F.size(found).alias("n"), F.array_sort(found).alias("links"))


on("validate_email", "customer", "c_custkey", lambda: [web.valid_email(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.when(F.col("c_custkey") % 2 == 0, "@mail.example.com").otherwise("@bad"))).alias("valid")], "c_custkey % 2 = 0 AS valid")
on("json_extract", "events", "event_id", lambda: [web.json_path(F.col("props"), "k").alias("k"), web.json_path(F.col("props"), "missing[0].x").isNotNull().alias("found")], "json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing[0].x') IS NOT NULL AS found")
on("base64_encode", "documents", "doc_id", lambda: [F.md5(b := web.base64_text(T())).alias("h"), F.length(b).alias("n")], "md5(to_base64(encode(text))) AS h, length(to_base64(encode(text)))::INT AS n")
on("base64_decode", "documents", "doc_id", lambda: [(web.unbase64_text(web.base64_text(T())) == T()).alias("same")], "decode(from_base64(to_base64(encode(text)))) = text AS same")
on("hash_text", "documents", "doc_id", lambda: [web.digest(T(), "md5").alias("md5"), web.digest(T(), "sha256").alias("sha256")], "md5(text) AS md5, sha256(text) AS sha256")
on("hash_sha512", "documents", "doc_id", lambda: [web.digest(T(), "sha512").alias("sha512")], None)
on("compress_data", "documents", "doc_id", lambda: [(d := web.deflated_size(T(), F.lit(6))).alias("compressed_size"), F.octet_length(T()).alias("original_size")], None)
on("encrypt_text", "nation", "n_nationkey", lambda: [F.base64(F.unhex(F.sha2(F.concat(F.lit('{"method": "aes256", "text": '), records.json_text(F.col("n_name")), F.lit("}")), 256))).alias("encrypted")], """to_base64(unhex(sha256('{"method": "aes256", "text": "' || n_name || '"}'))) AS encrypted""")

# records drawn from hashes


def mod(digits: str, n: int) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, {digits}), lambda a, x: (a * 16 + x) % {n})"


def digits(payload: str) -> str:
    return f"list_transform(range(1, 65), lambda i: (strpos('0123456789abcdef', substr(sha256({payload}), i::INT, 1)) - 1)::BIGINT)"


def drawn(name, of, key, payload, columns, sql, source=None):
    """A query of records: columns get the digest; sql uses d, its digits, and h, its text."""

    @query(name, f"SELECT {key}, {sql} FROM (SELECT *, {digits('payload')} AS d, sha256(payload) AS h FROM (SELECT *, {payload} AS payload FROM {of}))")
    def run(spark, sf):
        return table(spark, sf, of).select(key, *columns())


_NAME = """'["{}", "' || lower(n_name) || '"]'"""
R = records.remainder


def _weather():
    h = records.hashed("weather", F.lower("n_name"))
    return [(R(h, 45) - 5).alias("temperature"), (R(h, 60) + 30).alias("humidity"), R(h, 50).alias("wind"), records.pick(h, fixed.WEATHER).alias("condition"), (R(h, 45) - 7).alias("feels_like")]


drawn("get_weather", "nation", "n_nationkey", _NAME.format("weather"), _weather, f"{mod('d', 45)} - 5 AS temperature, {mod('d', 60)} + 30 AS humidity, {mod('d', 50)} AS wind, {listed(fixed.WEATHER)}[{mod('d', 7)} + 1] AS condition, {mod('d', 45)} - 7 AS feels_like")


def _stock():
    symbol = F.upper(F.substring("n_name", 1, 4))
    h = records.hashed("stock", symbol)
    price, change = R(h, 500) + 50, F.round((R(h, 200) - 100) / 10, 2)
    known = {s: (p, c) for s, _, p, c, _ in fixed.STOCKS}
    pick = lambda i, other: F.coalesce(*[F.when(symbol == s, F.lit(v[i])) for s, v in known.items()], other)
    p, c = pick(0, price.cast("double")), pick(1, change)
    return [p.alias("price"), c.alias("change"), F.round(c / p * 100, 2).alias("percent")]


drawn("get_stock_price", "nation", "n_nationkey", """'["stock", "' || upper(substr(n_name, 1, 4)) || '"]'""", _stock, f"({mod('d', 500)} + 50)::DOUBLE AS price, round(({mod('d', 200)} - 100) / 10, 2) AS change, round(round(({mod('d', 200)} - 100) / 10, 2) / ({mod('d', 500)} + 50)::DOUBLE * 100, 2) AS percent")


def _location():
    name = F.lower("n_name")
    h = records.hashed("location", name)
    at = lambda i, other: F.coalesce(*[F.when(name == c, F.lit(v[i])) for c, v in fixed.CITIES.items()], other.cast("double"))
    country = F.when(name.contains("tokyo"), "Japan").when(name.contains("paris"), "France").otherwise("Unknown")
    return [at(0, R(h, 180) - 90).alias("lat"), at(1, R(h, 360) - 180).alias("lon"), country.alias("country")]


drawn("get_location_info", "nation", "n_nationkey", _NAME.format("location"), _location, f"({mod('d', 180)} - 90)::DOUBLE AS lat, ({mod('d', 360)} - 180)::DOUBLE AS lon, 'Unknown' AS country")


def _directions():
    d = R(records.hashed("directions", F.col("n_name"), F.lit("Depot"), F.lit("transit")), 500) + 10
    minutes = F.round(d / 40 * 60).cast("long")
    return [d.alias("km"), F.round(d * 0.621371, 1).alias("miles"), minutes.alias("minutes"), F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("min"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min"))).alias("text")]


_KM = f"({mod('d', 500)} + 10)"
drawn("get_directions", "nation", "n_nationkey", """'["directions", "' || n_name || '", "Depot", "transit"]'""", _directions, f"{_KM} AS km, round({_KM} * 0.621371, 1) AS miles, round({_KM} / 40 * 60)::BIGINT AS minutes, CASE WHEN round({_KM} / 40 * 60) >= 60 THEN (round({_KM} / 40 * 60)::BIGINT // 60)::VARCHAR || 'h ' || (round({_KM} / 40 * 60)::BIGINT % 60)::VARCHAR || 'min' ELSE round({_KM} / 40 * 60)::BIGINT::VARCHAR || ' min' END AS text")


def _status():
    h = records.hashed("check_url", U())
    code = records.pick(h, fixed.HTTP_CODES)
    return [code.alias("code"), (R(h, 480) + 20).alias("ms"), F.when(code < 400, "reachable").when(code < 500, "client_error").otherwise("server_error").alias("status")]


_URL = """'["{}", "' || url || '"]'"""
_CODE = f"{fixed.HTTP_CODES}[{mod('d', 9)} + 1]"
drawn("check_url_status", "pages", "page_id", _URL.format("check_url"), _status, f"{_CODE} AS code, {mod('d', 480)} + 20 AS ms, CASE WHEN {_CODE} < 400 THEN 'reachable' WHEN {_CODE} < 500 THEN 'client_error' ELSE 'server_error' END AS status")
drawn("http_request", "pages", "page_id", """'["http_request", "' || url || '", "GET"]'""", lambda: [records.pick(h := records.hashed("http_request", U(), F.lit("GET")), fixed.HTTP_CODES).alias("code"), records.pick(h, fixed.RESPONSE_BODIES).alias("body")], f"{_CODE} AS code, {listed(fixed.RESPONSE_BODIES)}[{mod('d', 5)} + 1] AS body")


def _dns():
    h = records.hashed("dns", web.host(U()))
    octet = lambda i: F.conv(F.substring(h, 57 + 2 * i, 2), 16, 10)
    first = F.when(octet(0) == "0", "1").otherwise(octet(0))
    return [F.concat_ws(".", first, octet(1), octet(2), octet(3)).alias("ip"), (R(h, 3300) + 300).alias("ttl")]


drawn("dns_lookup", "pages", "page_id", r"""'["dns", "' || lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)) || '"]'""", _dns, f"concat_ws('.', greatest(d[57] * 16 + d[58], 1)::VARCHAR, (d[59] * 16 + d[60])::VARCHAR, (d[61] * 16 + d[62])::VARCHAR, (d[63] * 16 + d[64])::VARCHAR) AS ip, {mod('d', 3300)} + 300 AS ttl")


def _geo():
    h = records.hashed("geolocation", F.concat(F.lit("10.0.0."), F.col("page_id").cast("string")))
    return [records.pick(h, fixed.IP_COUNTRIES).alias("country"), records.pick(h, fixed.IP_CITIES).alias("city"), F.round((R(h, 18000) - 9000) / 100, 4).alias("lat"), F.round((R(h, 36000) - 18000) / 100, 4).alias("lon")]


drawn("ip_geolocation", "pages", "page_id", """'["geolocation", "10.0.0.' || page_id::VARCHAR || '"]'""", _geo, f"{listed(fixed.IP_COUNTRIES)}[{mod('d', 15)} + 1] AS country, {listed(fixed.IP_CITIES)}[{mod('d', 15)} + 1] AS city, round(({mod('d', 18000)} - 9000) / 100, 4) AS lat, round(({mod('d', 36000)} - 18000) / 100, 4) AS lon")
drawn("generate_image", "nation", "n_nationkey", """'["image", "' || n_name || '", "256x256", "sketch"]'""", lambda: [F.concat(F.lit("img_"), F.lpad(R(h := records.hashed("image", F.col("n_name"), F.lit("256x256"), F.lit("sketch")), 10**7).cast("string"), 7, "0")).alias("id"), F.concat(F.lit("https://images.example.com/generated/"), F.lpad(R(h, 10**6).cast("string"), 6, "0"), F.lit(".png")).alias("image_url"), F.lit(0.02).alias("cost")], f"'img_' || lpad({mod('d', 10**7)}::VARCHAR, 7, '0') AS id, 'https://images.example.com/generated/' || lpad({mod('d', 10**6)}::VARCHAR, 6, '0') || '.png' AS image_url, 0.02::DOUBLE AS cost")
drawn("send_webhook", "pages", "page_id", """'["webhook", "' || url || '", "ping"]'""", lambda: [(c := records.pick(records.hashed("webhook", U(), F.lit("ping")), fixed.WEBHOOK_CODES)).alias("code"), F.when(c < 300, "delivered").otherwise("failed").alias("status")], f"{fixed.WEBHOOK_CODES}[{mod('d', 8)} + 1] AS code, CASE WHEN {fixed.WEBHOOK_CODES}[{mod('d', 8)} + 1] < 300 THEN 'delivered' ELSE 'failed' END AS status")


def listed_records(name, of, key, seed, value, payload, columns, sql, n=5):
    """n records for each row."""

    @query(name, f"SELECT {key}, i, {sql} FROM (SELECT *, {digits('payload')} AS d FROM (SELECT *, {payload} AS payload FROM {of}, range(0, {n}) r(i)))")
    def run(spark, sf):
        rows = table(spark, sf, of).select(key, F.col(value).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i"))
        body = F.concat(F.lit(f'["{seed}", '), records.json_text(F.col("v")), F.lit(", "), F.col("i").cast("string"), F.lit("]"))
        return rows.withColumn("h", F.sha2(body, 256)).select(key, "i", *columns(F.col("h")))


_ITEM = """'["{}", "' || {} || '", ' || i::VARCHAR || ']'"""
listed_records("search_products", "nation", "n_nationkey", "product_item", "n_name", _ITEM.format("product_item", "n_name"), lambda h: [(R(h, 980) + 20).alias("price"), F.least(F.round(3.0 + R(h, 20) / 10, 1), F.lit(5.0)).alias("rating"), (R(h, 9950) + 50).alias("reviews"), (R(h, 5) != 0).alias("in_stock")], f"{mod('d', 980)} + 20 AS price, least(round(3.0::DOUBLE + {mod('d', 20)} / 10, 1), 5.0) AS rating, {mod('d', 9950)} + 50 AS reviews, {mod('d', 5)} <> 0 AS in_stock")
listed_records("web_search", "nation", "n_nationkey", "search_result", "n_name", _ITEM.format("search_result", "n_name"), lambda h: [F.concat(F.lit("https://"), records.pick(h, fixed.SEARCH_DOMAINS), F.lit("/article/"), R(h, 100000).cast("string")).alias("link"), records.pick(h, fixed.SEARCH_SOURCES).alias("source")], f"'https://' || {listed(fixed.SEARCH_DOMAINS)}[{mod('d', 10)} + 1] || '/article/' || {mod('d', 100000)}::VARCHAR AS link, {listed(fixed.SEARCH_SOURCES)}[{mod('d', 5)} + 1] AS source")
listed_records("rss_feed_parse", "pages", "page_id", "rss_item", "url", _ITEM.format("rss_item", "url"), lambda h: [records.pick(h, fixed.FEED_TITLES).alias("title"), F.format_string("2026-%02d-%02dT%02d:00:00Z", R(h, 12) + 1, R(h, 28) + 1, R(h, 24)).alias("published")], f"{listed(fixed.FEED_TITLES)}[{mod('d', 10)} + 1] AS title, printf('2026-%02d-%02dT%02d:00:00Z', {mod('d', 12)} + 1, {mod('d', 28)} + 1, {mod('d', 24)}) AS published")


def identified(name, prefix, payload, columns, sql):
    """Records with an identifier: prefix and twelve digits of the digest."""

    @query(name, f"SELECT c_custkey, '{prefix}_' || substr(sha256({payload}), 1, 12) AS id, {sql} FROM customer")
    def run(spark, sf):
        return table(spark, sf, "customer").select("c_custkey", *columns())


def C():
    return F.col("c_name")


def _body():
    return F.concat(F.lit("Dear "), C(), F.lit(", "), F.repeat(F.lit("thank you. "), 9))


_BODY_SQL = "'Dear ' || c_name || ', ' || repeat('thank you. ', 9)"
identified("send_email", "msg", """'["msg", {"subject": "Hi", "to": "' || c_name || '"}]'""", lambda: [records.keyed_identifier("msg", to=C(), subject=F.lit("Hi")).alias("id"), F.concat(F.substring(_body(), 1, 100), F.when(F.length(_body()) > 100, "...").otherwise("")).alias("preview")], f"substr({_BODY_SQL}, 1, 100) || CASE WHEN length({_BODY_SQL}) > 100 THEN '...' ELSE '' END AS preview")
identified("send_message", "chat", """'["chat", {"message": "Hello", "recipient": "' || c_name || '"}]'""", lambda: [records.keyed_identifier("chat", recipient=C(), message=F.lit("Hello")).alias("id"), F.substring(_body(), 1, 80).alias("preview")], f"substr({_BODY_SQL}, 1, 80) AS preview")
identified("create_notification", "notif", """'["notif", {"title": "' || c_name || '"}]'""", lambda: [records.keyed_identifier("notif", title=C()).alias("id"), F.coalesce(F.when(F.col("c_acctbal") < 0, "high"), F.lit("normal")).alias("priority")], "CASE WHEN c_acctbal < 0 THEN 'high' ELSE 'normal' END AS priority")
identified("create_task", "task", """'["task", {"title": "' || c_name || '"}]'""", lambda: [records.keyed_identifier("task", title=C()).alias("id"), F.coalesce(F.when(F.col("c_acctbal") > 5000, "high"), F.lit("medium")).alias("priority")], "CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'medium' END AS priority")
identified("schedule_meeting", "mtg", """'["mtg", {"datetime": "2026-03-01", "title": "' || c_name || '"}]'""", lambda: [records.keyed_identifier("mtg", title=C(), datetime=F.lit("2026-03-01")).alias("id"), F.coalesce(F.lit(None).cast("int"), F.lit(30)).alias("minutes")], "30 AS minutes")
identified("create_calendar_event", "evt", """'["cal_event", "' || c_name || '", "2026-03-01"]'""", lambda: [records.identifier("evt", "cal_event", C(), F.lit("2026-03-01")).alias("id"), F.lit(45).alias("minutes")], "45 AS minutes")
identified("set_reminder", "rem", """'["reminder", "' || c_name || '", "2026-03-01"]'""", lambda: [records.identifier("rem", "reminder", C(), F.lit("2026-03-01")).alias("id"), C().alias("message")], "c_name AS message")
identified("create_contact", "con", """'["contact", "' || c_name || '", "x@example.com"]'""", lambda: [records.identifier("con", "contact", C(), F.lit("x@example.com")).alias("id"), C().alias("name")], "c_name AS name")
identified("log_event", "log", """'["log_event", "signup", "' || c_name || '"]'""", lambda: [records.identifier("log", "log_event", F.lit("signup"), C()).alias("id"), F.lit(records.STAMP).alias("logged_at")], "'2026-02-22T12:00:00' AS logged_at")
identified("create_spreadsheet", "sht", """'["spreadsheet", "' || c_name || '"]'""", lambda: [records.identifier("sht", "spreadsheet", C()).alias("id"), F.size(F.split(C(), "")).alias("columns")], "length(c_name)::INT AS columns")


@query("get_exchange_rate", f"WITH r(currency, rate) AS (VALUES {', '.join(f'({q(c)}, {r!r}::DOUBLE)' for c, r in fixed.RATES.items())}) SELECT a.currency AS src, b.currency AS dst, round(b.rate / a.rate, 6) AS rate FROM r a, r b")
def get_exchange_rate(spark, sf):
    known = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c, r in fixed.RATES.items()])
    pairs = spark.range(1).select(F.explode(known).alias("a")).select("a", F.explode(known).alias("b"))
    return pairs.select(F.col("a.c").alias("src"), F.col("b.c").alias("dst"), F.round(F.col("b.r") / F.col("a.r"), 6).alias("rate"))


def translated(said, lang):
    """A known phrase in the language, else the text with the language's name."""
    known = F.map_from_arrays(*[F.array(*[F.lit(v) for v in c]) for c in zip(*((f"{p}|{g}", x) for p, t in fixed.PHRASES.items() for g, x in t.items()))])
    names = F.map_from_arrays(F.array(*map(F.lit, fixed.LANGUAGE_NAMES)), F.array(*map(F.lit, fixed.LANGUAGE_NAMES.values())))
    hit = F.try_element_at(known, F.concat_ws("|", F.rtrim(F.lower(F.trim(said)), F.lit(".")), lang))
    return F.coalesce(hit, F.concat(said, F.lit(" ("), F.coalesce(F.try_element_at(names, lang), F.upper(lang)), F.lit(" translation)")))


@query("translate_text", f"WITH t(k, lang, x) AS (VALUES {', '.join(f'({q(k)}, {q(lang)}, {q(x)})' for k, v in fixed.PHRASES.items() for lang, x in v.items())}), a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Thank you.' WHEN 1 THEN 'HELLO' ELSE c_name END AS s, CASE WHEN c_custkey % 2 = 0 THEN 'fr' ELSE 'ru' END AS lang FROM customer) SELECT c_custkey, coalesce(x, s || CASE a.lang WHEN 'fr' THEN ' (French translation)' ELSE ' (Russian translation)' END) AS translated FROM a LEFT JOIN t ON rtrim(lower(trim(s)), '.') = k AND a.lang = t.lang")
def translate_text(spark, sf):
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "Thank you.").when(k % 3 == 1, "HELLO").otherwise(C())
    return table(spark, sf, "customer").select("c_custkey", translated(said, F.when(k % 2 == 0, "fr").otherwise("ru")).alias("translated"))


on("web_page_fetch", "pages", "page_id", lambda: [text.title(F.replace(F.replace(F.substring_index(F.regexp_replace(U(), "[?#].*$", ""), "/", -1), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))).alias("title"), F.lit(200).alias("status_code")], r"array_to_string(list_transform(regexp_extract_all(lower(replace(replace(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '-', ' '), '_', ' ')), '\p{L}+|[^\p{L}]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS title, 200 AS status_code")
on("lookup_entity", "nation", "n_nationkey", lambda: [text.title(F.col("n_name")).alias("title"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("link")], r"array_to_string(list_transform(regexp_extract_all(lower(n_name), '\p{L}+|[^\p{L}]+'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS title, 'https://en.wikipedia.org/wiki/' || replace(n_name, ' ', '_') AS link")


@query("transcribe_audio", r"""WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(trim(text, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1␞', 'g'), '␞') AS p FROM conversations)
SELECT conv_id, turn, (i - 1)::INT AS segment, ((i - 1) * 5)::INT AS start, p[i] AS said FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM s)""")
def transcribe_audio(spark, sf):
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(text.sentences(T())).alias("segment", "said"))
    return said.select("conv_id", "turn", "segment", (F.col("segment") * 5).alias("start"), "said")
