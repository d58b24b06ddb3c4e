"""Results of ensemble searches as JSON documents, one for each request, and back.

Reading is strict: a document has to be what writing its content gives, so an unknown or
misplaced field, a number in another layout and a value of another kind are errors, and so
are contents that contradict themselves.

A document of any number of members is written and read in pieces, rows of bounded size that
make the text one after the other; what holds for the whole is told from sorted rows that pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ensemble import class_rank
from tidemark.operators.interpolation import small

#: Fixed value: the version that documents carry.
VERSION = "ensemble_route_result_v1"

_MEMBER = "struct<identifier: string, original_weight: double, normalized_weight: double, fault: string>"
_OUTCOME = "struct<identifier: string, outcome_class: string, elapsed_seconds: double, latitude: double, longitude: double>"
_NODE = "struct<node: string, depth: bigint, terminal: boolean, outgoing: bigint>"
_BRANCH = "struct<branch: string, from_node: string, to_node: string, action: string, cost: double, selected: boolean, needs_review: boolean>"
_ABOUT = "struct<run_identifier: string, model_identifier: string, schema_revision: bigint>"
_HEAD = f"struct<schema_version: string, run_metadata: {_ABOUT}, member_metadata: array<{_MEMBER}>>"
_RESULT = f"struct<objective: double, incomplete_weight: double, finite_mean_seconds: double, worst_finite_seconds: double, headings: array<double>, members: array<{_OUTCOME}>>"
#: Members of a piece of a document, at most.
PIECE = 1000
SCHEMA = f"struct<schema_version: string, run_metadata: struct<run_identifier: string, model_identifier: string, schema_revision: bigint>, member_metadata: array<{_MEMBER}>, result: struct<objective: double, incomplete_weight: double, finite_mean_seconds: double, worst_finite_seconds: double, headings: array<double>, members: array<{_OUTCOME}>, policy: struct<nodes: array<{_NODE}>, branches: array<{_BRANCH}>>>>"


def _listed(rows: DataFrame, keys: list[str], fields: dict[str, Column], kind: str, by: str, name: str) -> DataFrame:
    """(keys..., name): the rows of each key as an array in order of a field."""
    one = F.struct(*(v.alias(k) for k, v in fields.items()))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("_by"), one.alias("x")))), lambda s: s["x"])
    return rows.groupBy(*keys).agg(listed.cast(f"array<{kind}>").alias(name))


def ensemble_documents(courses: DataFrame, outcomes: DataFrame, members: DataFrame, keys: list[str], run: str, model: str, revision: int = 1, policy: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys..., json).

    courses: (keys..., objective, incomplete_weight, mean_s, worst_s, headings); an infinite
    objective is left out. outcomes: (keys..., member, outcome, elapsed_s, lat, lon).
    members: (member, weight, normalized_weight, fault), the same for all documents or with the
    keys. policy: nodes and branches (keys..., ...) as merged_policy gives them.
    """
    c = F.col
    of = {"identifier": c("member").cast("string"), "outcome_class": c("outcome"), "elapsed_seconds": c("elapsed_s").cast("double"), "latitude": c("lat"), "longitude": c("lon")}
    d = courses.join(_listed(outcomes, keys, of, _OUTCOME, "member", "_outcomes"), keys, "left")
    own = [k for k in keys if k in members.columns]
    meta = {"identifier": c("member").cast("string"), "original_weight": c("weight").cast("double"), "normalized_weight": c("normalized_weight"), "fault": c("fault") if "fault" in members.columns else F.lit(None).cast("string")}
    listed = _listed(members, own, meta, _MEMBER, "member", "_members")
    d = d.join(listed, own, "left") if own else d.join(F.broadcast(listed), F.lit(True))
    graph = F.lit(None).cast(f"struct<nodes: array<{_NODE}>, branches: array<{_BRANCH}>>")
    if policy is not None:
        nodes = _listed(policy[0], keys, {x: c(x) for x in ("node", "depth", "terminal", "outgoing")}, _NODE, "node", "_nodes")
        branches = _listed(policy[1], keys, {x: c(x) for x in ("branch", "from_node", "to_node", "action", "cost", "selected", "needs_review")}, _BRANCH, "branch", "_branches")
        d = d.join(nodes, keys, "left").join(branches, keys, "left")
        graph = F.struct(c("_nodes").alias("nodes"), c("_branches").alias("branches"))
    infinite = F.isnan("objective") | (F.abs("objective") == float("inf"))
    result = F.struct(F.when(~infinite, c("objective")).alias("objective"), "incomplete_weight", c("mean_s").alias("finite_mean_seconds"), c("worst_s").cast("double").alias("worst_finite_seconds"), "headings", c("_outcomes").alias("members"), graph.alias("policy"))
    about = F.struct(F.lit(run).alias("run_identifier"), F.lit(model).alias("model_identifier"), F.lit(revision).cast("long").alias("schema_revision"))
    document = F.struct(F.lit(VERSION).alias("schema_version"), about.alias("run_metadata"), c("_members").alias("member_metadata"), result.alias("result")).cast(SCHEMA)
    return d.select(*keys, F.to_json(document).alias("json"), _fault(document).alias("_fault")).where(_sound("_fault")).drop("_fault")


def _fault(doc: Column) -> Column:
    """What contradicts itself in a document; null where nothing does."""
    members, result = doc["member_metadata"], doc["result"]
    names = lambda xs: F.transform(xs, lambda m: m["identifier"])
    some = lambda xs, wrong: F.exists(F.coalesce(xs, F.array().cast(f"array<{_MEMBER if xs is members else _OUTCOME}>")), lambda x: F.coalesce(wrong(x), F.lit(True)))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    total = F.aggregate(members, F.lit(0.0), lambda s, m: s + m["normalized_weight"])
    reached = lambda m: m["outcome_class"] == "reached"
    branches = F.coalesce(result["policy"]["branches"], F.array().cast(f"array<{_BRANCH}>"))
    nodes = F.transform(F.coalesce(result["policy"]["nodes"], F.array().cast(f"array<{_NODE}>")), lambda n: n["node"])
    return (
        F.when(F.coalesce(doc["schema_version"] != VERSION, F.lit(True)), "unknown version")
        .when(F.coalesce((doc["run_metadata"]["run_identifier"] == "") | (doc["run_metadata"]["model_identifier"] == "") | (doc["run_metadata"]["schema_revision"] < 1), F.lit(True)), "the run has no name, model or revision")
        .when(F.coalesce(F.size(members) < 1, F.lit(True)), "no members")
        .when(some(members, lambda m: (m["identifier"] == "") | ~number(m["original_weight"]) | (m["original_weight"] < 0)), "a member without a name or weight")
        .when(F.size(F.array_distinct(names(members))) != F.size(members), "a member twice")
        .when(F.abs(total - 1) > 1e-9, "weights do not add up to 1")
        .when(F.coalesce(F.array_sort(names(members)) != F.array_sort(names(result["members"])), F.lit(True)), "outcomes are not those of the members")
        .when(some(result["members"], lambda m: class_rank(m["outcome_class"]) < 0), "unknown outcome class")
        .when(some(result["members"], lambda m: reached(m) != number(m["elapsed_seconds"])), "an arrival without a time, or a time without an arrival")
        .when(F.exists(branches, lambda b: ~F.array_contains(nodes, b["from_node"]) | ~F.array_contains(nodes, b["to_node"])), "a branch without its nodes")
    )


def _sound(fault: str) -> Column:
    return F.when(F.col(fault).isNotNull(), F.raise_error(F.concat(F.lit("ensemble document: "), F.col(fault))).cast("boolean")).otherwise(F.lit(True))


def read_ensemble_documents(documents: DataFrame, keys: list[str], text: str = "json") -> DataFrame:
    """(keys..., document) of strict documents; an error for any other."""
    d = documents.select(*keys, F.col(text).alias("_text"), F.from_json(text, SCHEMA, {"mode": "FAILFAST"}).alias("document"))
    known = F.coalesce(F.to_json("document") == F.col("_text"), F.lit(False))
    d = d.withColumn("_fault", F.when(~known, "fields or numbers in another layout").otherwise(_fault(F.col("document"))))
    return d.where(_sound("_fault")).select(*keys, "document")


def document_outcomes(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., member, weight, class_rank, elapsed) of read documents."""
    m = documents.select(*keys, F.explode(F.arrays_zip(F.array_sort("document.member_metadata").alias("a"), F.array_sort("document.result.members").alias("b"))).alias("m"))
    return m.select(*keys, F.col("m.a.identifier").alias("member"), F.col("m.a.original_weight").alias("weight"), class_rank(F.col("m.b.outcome_class")).alias("class_rank"), F.col("m.b.elapsed_seconds").alias("elapsed"))


def document_pieces(courses: DataFrame, rows: DataFrame, keys: list[str], run: str, model: str, revision: int = 1, size: int = PIECE) -> DataFrame:
    """(keys..., section, part, json): documents without a policy in pieces; in order of section and part they make what ensemble_documents writes.

    Sections: 0 the beginning, 1 members, 2 the result, 3 outcomes, 4 the end; 1 and 3 have parts
    of `size` members. rows: (keys..., member, weight, normalized_weight, outcome, elapsed_s,
    lat, lon, maybe fault), one for each member. A course without rows has no document.
    """
    c = F.col
    meta = {"identifier": c("member").cast("string"), "original_weight": c("weight").cast("double"), "normalized_weight": c("normalized_weight"), "fault": c("fault") if "fault" in rows.columns else F.lit(None).cast("string")}
    of = {"identifier": c("member").cast("string"), "outcome_class": c("outcome"), "elapsed_seconds": c("elapsed_s").cast("double"), "latitude": c("lat"), "longitude": c("lon")}
    one = F.struct(c("member").alias("_by"), *(F.struct(*(v.alias(k) for k, v in x.items())).alias(name) for name, x in (("m", meta), ("o", of))))
    part = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("member")) - 1) / size).cast("int")
    listed = rows.withColumn("part", part).groupBy(*keys, "part").agg(F.sort_array(F.collect_list(one)).alias("_l"))
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    text = lambda f, kind: F.concat(F.when(c("part") > 0, ",").otherwise(""), inner(F.to_json(F.transform("_l", lambda x: x[f]).cast(f"array<{kind}>"))))
    infinite = F.isnan("objective") | (F.abs("objective") == float("inf"))
    about = F.struct(F.lit(run).alias("run_identifier"), F.lit(model).alias("model_identifier"), F.lit(revision).cast("long").alias("schema_revision"))
    head = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), about.alias("run_metadata"), F.array().alias("member_metadata")).cast(_HEAD))
    result = F.to_json(F.struct(F.when(~infinite, c("objective")).alias("objective"), "incomplete_weight", c("mean_s").alias("finite_mean_seconds"), c("worst_s").cast("double").alias("worst_finite_seconds"), "headings", F.array().alias("members")).cast(_RESULT))
    begun = lambda x: F.substring(x, F.lit(1), F.length(x) - 2)
    piece = lambda section, json: F.struct(F.lit(section).alias("section"), json.alias("json"))
    many = F.array(piece(1, text("m", _MEMBER)), piece(3, text("o", _OUTCOME)))
    once = F.array(piece(0, c("_head")), piece(2, c("_result")), piece(4, F.lit(_END)))
    facts = courses.select(*keys, begun(head).alias("_head"), F.concat(F.lit(_TURN), begun(result)).alias("_result"))
    made = listed.join(small(facts), keys).select(*keys, "part", F.explode(F.when(c("part") == 0, F.concat(once, many)).otherwise(many)).alias("p"))
    return made.select(*keys, "p.section", "part", "p.json")


#: What stands between the members and the result, and after the outcomes.
_TURN, _END = '],"result":', "]}}"


def read_document_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., member, weight, class_rank, elapsed) of documents in pieces, as strict as read_ensemble_documents; an error for any other.

    Nothing is gathered by document: pieces are told apart, members meet their outcomes by name,
    and what holds for a whole document is seen as its sorted rows pass.
    """
    c = F.col
    none = lambda kind: F.lit(None).cast(kind)
    strict = {"mode": "FAILFAST"}
    first, further = c("part") == 0, (c("part") > 0) & c("json").startswith(",")
    body = F.concat(F.lit("["), F.when(first, c("json")).when(further, F.substring("json", F.lit(2), F.length("json"))), F.lit("]"))
    whole = F.when(c("section") == 0, F.concat("json", F.lit("]}"))).when((c("section") == 2) & c("json").startswith(_TURN), F.concat(F.substring("json", F.lit(len(_TURN) + 1), F.length("json")), F.lit("]}"))).when(c("section").isin(1, 3), body)
    p = pieces.select(*keys, "section", "part", (first & (c("json") == _END)).alias("_ended"), whole.alias("_text"))
    p = p.withColumns({"_h": F.from_json(F.when((c("section") == 0) & first, c("_text")), _HEAD, strict), "_m": F.from_json(F.when(c("section") == 1, c("_text")), f"array<{_MEMBER}>", strict),
        "_r": F.from_json(F.when((c("section") == 2) & first, c("_text")), _RESULT, strict), "_o": F.from_json(F.when(c("section") == 3, c("_text")), f"array<{_OUTCOME}>", strict)})
    same = F.when(c("section") == 0, F.to_json("_h") == c("_text")).when(c("section") == 1, (F.to_json("_m") == c("_text")) & (F.size("_m") > 0)).when(c("section") == 2, F.to_json("_r") == c("_text")).when(c("section") == 3, (F.to_json("_o") == c("_text")) & (F.size("_o") > 0)).when(c("section") == 4, c("_ended"))
    about = c("_h.run_metadata")
    wrong = (
        F.when(~F.coalesce(same, F.lit(False)), "fields or numbers in another layout")
        .when((c("section") == 0) & F.coalesce(c("_h.schema_version") != VERSION, F.lit(True)), "unknown version")
        .when((c("section") == 0) & F.coalesce((about["run_identifier"] == "") | (about["model_identifier"] == "") | (about["schema_revision"] < 1), F.lit(True)), "the run has no name, model or revision")
    )
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kinds = {"member": "string", "section": "int", "part": "int", "metas": "int", "ends": "int", "weight": "double", "share": "double", "class_rank": "int", "elapsed": "double", "wrong": "string"}
    entry = lambda **has: F.struct(*(has.get(k, F.lit(0) if k in ("metas", "ends") else F.lit(-1) if k in ("section", "part") else none(kind)).cast(kind).alias(k) for k, kind in kinds.items()))
    nameless = lambda x: F.coalesce(x["identifier"] == "", F.lit(True))
    member = lambda x: entry(member=x["identifier"], metas=F.lit(1), weight=x["original_weight"], share=x["normalized_weight"], wrong=F.when(nameless(x) | ~number(x["original_weight"]) | (x["original_weight"] < 0), "a member without a name or weight"))
    late = lambda x: F.coalesce((x["outcome_class"] == "reached") != number(x["elapsed_seconds"]), F.lit(True))
    rank = lambda x: class_rank(x["outcome_class"])
    outcome = lambda x: entry(member=x["identifier"], ends=F.lit(1), class_rank=rank(x), elapsed=x["elapsed_seconds"], wrong=F.when(nameless(x), "a member without a name or weight").when(F.coalesce(rank(x) < 0, F.lit(True)), "unknown outcome class").when(late(x), "an arrival without a time, or a time without an arrival"))
    own = F.array(entry(section=c("section"), part=c("part"), wrong=wrong))
    entries = F.when(c("section") == 1, F.concat(own, F.transform("_m", member))).when(c("section") == 3, F.concat(own, F.transform("_o", outcome))).otherwise(own)
    e = p.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    e = e.groupBy(*keys, "member", "section", "part").agg(F.count("*").alias("_n"), F.sum("metas").alias("metas"), F.sum("ends").alias("ends"), F.max("weight").alias("weight"), F.sum("share").alias("share"), F.max("class_rank").alias("class_rank"), F.max("elapsed").alias("elapsed"), F.max("wrong").alias("wrong"))
    w = Window.partitionBy(*keys).orderBy("member", "section", "part")
    e = e.withColumns({"_before": F.lag(F.struct("section", "part")).over(w), "_after": F.lead("section").over(w), "_total": F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    s, q, bs, bp = c("section"), c("part"), c("_before.section"), c("_before.part")
    follows = F.when(c("_before").isNull(), (s == 0) & (q == 0)).when(s == -1, (bs == -1) | (bs == 4)).when(s == bs, s.isin(1, 3) & (q == bp + 1)).otherwise((s == bs + 1) & (q == 0))
    fault = (
        F.when(c("wrong").isNotNull(), c("wrong"))
        .when(~F.coalesce(follows, F.lit(False)) | (s >= 0) & (c("_n") != 1), "pieces are missing or there twice")
        .when((s == -1) & ((c("metas") > 1) | (c("ends") > 1)), "a member twice")
        .when((s == -1) & ((c("metas") != 1) | (c("ends") != 1)), "outcomes are not those of the members")
        .when(c("_after").isNull() & (s >= 0), "no members")
        .when(c("_after").isNull() & ~F.coalesce(F.abs(c("_total") - 1) <= 1e-9, F.lit(False)), "weights do not add up to 1")
    )
    e = e.withColumn("_fault", fault)
    e = e.where(_sound("_fault") & (s < 0))  # not s == -1, which Spark would put for s in the fault
    return e.select(*keys, "member", "weight", "class_rank", "elapsed")
