"""Rule-based query decomposition: two entities and a comparing cue, or three and a summing one, make a branch each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import text as T

# Cues in the order they are removed, connectives, and the plans' sizes.
COMPARE_CUES = ("谁更高", "谁更低", "谁更好", "谁更强", "谁更优", "哪个更高", "哪个更低", "哪个更好", "哪个更强", "哪个更优")
SUMMARY_CUES = ("归纳总结", "总结一下", "归纳一下", "总结", "归纳")
COMPARE_WORDS = ("以及", "相比", "对比", "比较", "和", "与", "及", "、")
SUMMARY_WORDS = ("以及", "一下", "和", "与", "及", "、")
ASPECT_BEGIN, ASPECT_END = r"^[的\s]+", "[。；;，,]+$"
PLANS = {"compare": (2, 25, 5), "summary": (3, 15, 4)}


#: Parts of a document id that hold one of these are no names.
NO_NAMES = ("证券", "研究院", "大学", "行业", "周报", "点评", "策略", "计算机", "电子", "公用事业", "互联网")


def entity_dictionary(names: DataFrame, column: str) -> DataFrame:
    """Distinct names of two characters and more, longest first."""
    name = T.strip(column)
    return names.select(name.alias("name")).where(F.length("name") >= 2).distinct().orderBy(F.desc(F.length("name")), "name")


def names_of_documents(docs: DataFrame) -> DataFrame:
    """name: the companies of documents (doc_id, company), and the parts of their ids that read like names, each once.

    A part is what stands between underscores, without digits; names have two characters
    and more, an ideograph, and none of the words of NO_NAMES.
    """
    part = T.strip(F.regexp_replace("part", r"\d+", ""))
    parts = docs.select(F.explode(F.split(F.col("doc_id").cast("string"), "_")).alias("part")).select(part.alias("name"))
    parts = parts.where((F.length("name") >= 2) & F.col("name").rlike("[一-鿿]") & ~F.col("name").rlike("|".join(NO_NAMES)))
    companies = docs.select(T.strip("company").alias("name")).where("name != ''")
    return companies.unionByName(parts).distinct()


def names_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, entities: the names that each distinct text of ``texts`` (column text) holds, by place; texts without any are left out.

    Names meet texts by their first two characters (names of one by that one), which
    tell how long the names are that begin so; then whole names are joined. Neither
    side is gathered, and a beginning that many names share costs no more than their
    lengths. Of a text's names the longest come first, then the least; each takes its
    first place, and none goes over another.
    """
    known = names.select("name").where("name != ''").distinct()
    begin = lambda c, at: F.substr(c, at, F.lit(2))
    lengths = known.groupBy(F.left("name", F.lit(2)).alias("begin")).agg(F.collect_set(F.length("name")).alias("lengths"))
    places = texts.select("text").where("text != ''").distinct().withColumn("start", F.explode(F.sequence(F.lit(1), F.length("text"))))
    # the last character is a beginning by itself, and so is any that is a name of its own
    begins = F.array_distinct(F.array(begin(F.col("text"), F.col("start")), F.substr("text", F.col("start"), F.lit(1))))
    met = places.withColumn("begin", F.explode(begins)).join(lengths, "begin").withColumn("n", F.explode("lengths"))
    met = met.where((F.length("begin") == F.least("n", F.lit(2))) & (F.col("start") + F.col("n") - 1 <= F.length("text")))
    found = met.select("text", "start", F.substr("text", F.col("start"), F.col("n")).alias("name")).join(known, "name", "left_semi")
    first = found.groupBy("text", "name").agg(F.min("start").alias("start"))
    held = first.groupBy("text").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("less"), "name", "start"))).alias("held"))
    return held.select("text", F.transform(spans_of("held"), lambda s: s["name"]).alias("entities"))


def spans_of(held: Column | str) -> Column:
    """array<struct<start, name>> by place, of names (name, start) in the order in which they may take their places, none over another."""
    over = lambda u, s: (s["start"] < u["start"] + F.length(u["name"])) & (u["start"] < s["start"] + F.length(s["name"]))
    span = lambda s: F.struct(s["start"].cast("int").alias("start"), s["name"].alias("name"))
    empty = F.array().cast("array<struct<start:int,name:string>>")
    return F.array_sort(F.aggregate(held, empty, lambda used, s: F.when(F.exists(used, lambda u: over(u, s)), used).otherwise(F.array_append(used, span(s)))))


def entity_spans(query: Column, names: Column) -> Column:
    """``spans_of`` the names of an array, for a few of them; ``names_in`` joins with many."""
    at = F.transform(names, lambda n: F.struct((-F.length(n)).alias("less"), n.alias("name"), F.instr(query, n).alias("start")))
    return spans_of(F.array_sort(F.filter(at, lambda s: s["start"] > 0)))


def _aspect(query: Column, entities: Column, words: tuple[str, ...]) -> Column:
    left = F.aggregate(F.concat(entities, F.array(*map(F.lit, words))), query, lambda q, w: F.replace(q, w, F.lit(" ")))
    return F.regexp_replace(F.regexp_replace(T.compact(left), ASPECT_BEGIN, ""), ASPECT_END, "")


def plan(queries: DataFrame, names: DataFrame, final_k: int = 10) -> DataFrame:
    """Adds plan: struct<query_type, subqueries, branch_candidate_k, branch_output_k, final_top_k>, null where no rule applies.

    queries: query_id, query; names: name, a dictionary of any size.
    """
    rows = queries.withColumn("q__", T.normalize_query("query"))
    found = names_in(rows.select(F.col("q__").alias("text")), names).select(F.col("text").alias("q__"), F.col("entities").alias("e__"))
    rows = rows.join(found, "q__", "left").withColumn("e__", F.coalesce("e__", F.array().cast("array<string>")))
    has = lambda cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains("q__", c))

    def made(kind: str, words: tuple[str, ...]) -> Column:
        _, candidates, output = PLANS[kind]
        aspect = _aspect(F.col("q__"), F.col("e__"), words)
        parts = F.transform("e__", lambda e: T.compact(F.concat(e, F.lit(" "), aspect)))
        return F.struct(F.lit(kind).alias("query_type"), parts.alias("subqueries"), F.lit(candidates).alias("branch_candidate_k"), F.lit(output).alias("branch_output_k"), F.lit(final_k).alias("final_top_k"))

    made_plan = F.when((F.size("e__") == 2) & has(COMPARE_CUES), made("compare", COMPARE_CUES + COMPARE_WORDS)).when(
        (F.size("e__") == 3) & has(SUMMARY_CUES), made("summary", SUMMARY_CUES + SUMMARY_WORDS)
    )
    return rows.withColumn("plan", made_plan).select(*queries.columns, "plan")


def branches(planned: DataFrame) -> DataFrame:
    """query_id, branch, query: a row per subquery, or the query itself as branch 0 where there is no plan."""
    parts = F.coalesce(F.col("plan.subqueries"), F.array("query"))
    return planned.select("query_id", F.posexplode(parts).alias("branch", "query"))


def planned_branches(planned: DataFrame) -> DataFrame:
    """query_id, branch, query, query_type ("fact" without a plan), branch_candidate_k, branch_output_k (null without a plan)."""
    parts = F.coalesce(F.col("plan.subqueries"), F.array("query"))
    kind = F.coalesce("plan.query_type", F.lit("fact")).alias("query_type")
    return planned.select("query_id", kind, F.col("plan.branch_candidate_k").alias("branch_candidate_k"), F.col("plan.branch_output_k").alias("branch_output_k"), F.posexplode(parts).alias("branch", "query"))


def infer_type(query: Column, components: Column) -> Column:
    """summary, compare or fact: by cue words first, then by the number of gold components."""
    has = lambda cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(query, c))
    return F.when(has(SUMMARY_CUES), "summary").when(has(COMPARE_CUES), "compare").when(components >= 3, "summary").when(components == 2, "compare").otherwise("fact")
