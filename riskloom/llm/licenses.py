"""Licence scan by sentence rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, maybe_broadcast, row_key
from riskloom.llm.licence_texts import KEY_WORDS, RULES, SENTENCE_END, SENTENCES, SPDX, SPDX_SENTENCE

def _fixed_table(spark: SparkSession, rows: list[dict[str, Column]]) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in row.items()]) for row in rows])))


def _pattern(sentence: str) -> tuple[str, str | None]:
    """What a sentence starts with, and what it ends with if any words may stand between."""
    head, star, tail = sentence.partition("*")
    return head, tail if star else None


def _sentence_table(spark: SparkSession, sentences: dict[str, str]) -> DataFrame:
    rows = [(sid, " ".join(s.split()[:KEY_WORDS]), *_pattern(s)) for sid, s in sentences.items()]
    return _fixed_table(spark, [{"sid": F.lit(sid), "key": F.lit(key), "head": F.lit(head), "tail": F.lit(tail).cast("string")} for sid, key, head, tail in rows])


def _rule_table(spark: SparkSession, rules: list[tuple[str, list[str]]]) -> DataFrame:
    return _fixed_table(spark, [{"rule": F.lit(n), "licence": F.lit(name), "ids": F.array(*map(F.lit, ids))} for n, (name, ids) in enumerate(rules)])


def _normal(lowered: Column) -> Column:
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def scan_licenses(docs: DataFrame, *, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Licences whose rules match the known licence sentences of each document of ``docs (doc_id, text, ...)``.

    Texts are cut into sentences, which may run over single line breaks and comment leaders (see
    ``SENTENCE_END``), normalised, and looked up by their first words; a star in a known sentence stands for any
    words. Where a sentence of several lines isn't known as a whole, each of its lines is tried by itself, so that a
    one-line tag needs no full stop. The identifiers found, in text order, are the document's sequence. A rule
    matches where its identifiers stand next to each other in that sequence: unknown sentences may lie between.
    Of matches that start together the longest counts, and none that lies inside another.

    Returns one row per input row: ``doc_id, n_sentences`` (not blank), ``n_known, licenses`` (names, sorted,
    each once, joined by commas; empty if none), ``n_matches``. Null and blank texts have no sentences; an empty table
    gives an empty result; texts of any length are read whole. Rows that repeat an id and text whole give equal rows; a
    null doc_id is an id like others; other columns are ignored. A sentence that fits two patterns counts as the one without a star,
    then as the one with the smaller identifier; of equally long rules the first is taken.
    """
    spark = docs.sparkSession
    known, rule_table = _sentence_table(spark, sentences), _rule_table(spark, rules)  # fixed tables: safe to broadcast
    end = "\0end"  # stands after the last sentence: one row for each document, which carries the count
    known = known.union(_fixed_table(spark, [{"sid": F.lit(None).cast("string"), "key": F.lit(end), "head": F.lit(end), "tail": F.lit(None).cast("string")}]))
    whole = F.replace(F.coalesce("text", F.lit("")), F.lit(SPDX), F.lit(SPDX_SENTENCE))
    parts = F.filter(F.split(whole, SENTENCE_END), lambda x: x.rlike(r"\S"))
    each = docs.select(row_key().alias("doc"), F.posexplode_outer(F.concat(parts, F.array(F.lit(None).cast("string")))).alias("pos", "part"))
    tried = F.when(F.contains("part", F.lit("\n")), F.concat(F.array("part"), F.split("part", "\n"))).otherwise(F.array("part"))
    each = each.select("doc", "pos", F.posexplode(tried).alias("line", "part")).select("doc", "pos", "line", F.lower("part").alias("part"))
    begins = sorted({x.split()[0] for x in sentences.values()})  # a first look, so that few sentences are normalised whole
    each = each.where(F.col("part").isNull() | F.regexp_extract("part", "^[^a-z0-9]*+([a-z0-9]++)", 1).isin(begins))
    each = each.select("doc", "pos", "line", F.coalesce(_normal(F.col("part")), F.lit(end)).alias("sentence"))
    fits = F.when(F.col("tail").isNull(), F.col("sentence") == F.col("head")).otherwise(F.startswith("sentence", "head") & F.endswith("sentence", "tail"))
    hits = each.withColumn("key", F.substring_index("sentence", " ", KEY_WORDS)).join(F.broadcast(known), "key").where(fits)
    hits = materialize(hits.select("doc", "pos", "line", "sid", F.col("tail").isNotNull().alias("open")), "licence-sentences")

    once = hits.where("sid is not null").groupBy("doc", "pos", "line").agg(F.min(F.struct("open", "sid"))["sid"].alias("sid"))
    whole_known = F.min("line").over(Window.partitionBy("doc", "pos")) == 0
    found = once.withColumn("whole", whole_known).where("line = 0 or not whole")
    found = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "sid"))).alias("known"))
    found = materialize(found.select("doc", F.transform("known", lambda x: x["sid"]).alias("seq")), "licence-sequences")
    starts = found.select("doc", "seq", F.posexplode("seq").alias("i", "first"))
    tried = starts.join(F.broadcast(rule_table.withColumn("first", F.get("ids", F.lit(0)))), "first")
    matched = tried.where(F.slice("seq", F.col("i") + 1, F.size("ids")) == F.col("ids"))
    longest = matched.groupBy("doc", "i").agg(F.max_by(F.struct("licence", F.size("ids").alias("n")), F.struct(F.size("ids"), -F.col("rule"))).alias("m"))
    longest = longest.select("doc", "i", "m.licence", (F.col("i") + F.col("m.n")).alias("end"))
    reached = F.max("end").over(Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    outer = longest.withColumn("reached", reached).where("reached is null or end > reached")
    licenses = outer.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licenses"), F.count("*").alias("n_matches"))

    per_doc = materialize(found.select("doc", F.size("seq").cast("bigint").alias("n_known")).join(licenses, "doc", "left"), "licences")
    out = hits.where("sid is null").select("doc", F.col("pos").cast("bigint").alias("n_sentences")).join(maybe_broadcast(per_doc, "1 + octet_length(coalesce(licenses, '')) div 32"), "doc", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc.doc_id", "n_sentences", F.coalesce("n_known", zero).alias("n_known"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_matches", zero).alias("n_matches"))


#: The cuts for engines without look-behind and possessive forms.
_PLAIN_CUT = (
    r"""([^ \t\n\r\f\x0B.?!:;])[.?!:;]+["')\]]*[ \t\n\r\f\x0B]+(?:\(?(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]+)?|\n[ \t\r\f\x0B!-/:-@\[-`{-~]*\n|[*=#_~-]{3,}[ \t\r]*\n|\n[ \t#*/;%>|!-]*\(?(?:[0-9]{1,2}|[A-Za-z])[.)][ \t]+"""
)


def licenses_sql(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    known = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (sid, *_pattern(s))) + ")" for sid, s in sentences.items())
    ruled = ", ".join(f"({n}, '{licence}', {ids!r})" for n, (licence, ids) in enumerate(rules))
    cut = _PLAIN_CUT.replace("'", "''")
    return f"""
WITH known(sid, head, tail) AS (VALUES {known}),
rules(rule, licence, ids) AS (VALUES {ruled}),
d AS (SELECT doc_id, [x for x in string_split(regexp_replace(replace(coalesce(text, ''), '{SPDX}', chr(10) || chr(10) || 'spdx '), '{cut}', '\\1' || chr(1), 'g'), chr(1)) if regexp_matches(x, '[^ \t\n\r\f\x0B]')] AS p FROM documents),
e AS (SELECT doc_id, i, p[i] AS whole FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM d)),
c AS (SELECT doc_id, i, 0 AS line, whole AS part FROM e
      UNION ALL SELECT doc_id, i, k, string_split(whole, chr(10))[k] FROM (SELECT *, unnest(generate_series(1, len(string_split(whole, chr(10))))) AS k FROM e WHERE contains(whole, chr(10)))),
s AS (SELECT doc_id, i, line, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'), ' ') AS sentence FROM c),
x AS (SELECT doc_id, i, line, arg_min(sid, (tail IS NOT NULL, sid)) AS sid FROM s JOIN known ON sentence = head OR (tail IS NOT NULL AND starts_with(sentence, head) AND suffix(sentence, tail)) GROUP BY ALL),
h AS (SELECT doc_id, list(sid ORDER BY i, line) AS seq FROM (SELECT *, min(line) OVER (PARTITION BY doc_id, i) AS least FROM x) WHERE line = 0 OR least > 0 GROUP BY doc_id),
t AS (SELECT doc_id, seq, unnest(generate_series(1, len(seq))) AS i FROM h),
m AS (SELECT doc_id, i, arg_max(licence, (len(ids), -rule)) AS licence, i + max(len(ids)) AS past FROM t, rules WHERE seq[i:i + len(ids) - 1] = ids GROUP BY doc_id, i),
o AS (SELECT *, max(past) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m),
l AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licenses, count(*) AS n_matches FROM o WHERE reached IS NULL OR past > reached GROUP BY doc_id)
SELECT d.doc_id, len(p)::BIGINT AS n_sentences, coalesce(len(seq), 0)::BIGINT AS n_known, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0)::BIGINT AS n_matches
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""
