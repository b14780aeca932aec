"""Readers and writers of the usual entity-alignment layouts. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.functions import text as X
from twinweave.functions.generators import nfc
from twinweave.operators.relational import attribute_triples, first_seen_ids, relation_triples, vocabulary
from twinweave.operators.splits import split_positions
from twinweave.operators.structure import equivalence_expansion, masked, merged_triples
from twinweave.plans.kg import Dataset
from twinweave.functions.text import latex_escape
from twinweave.plans.ranks import global_row_number
from twinweave.plans.registry import READERS, WRITERS
from twinweave.sources.turtle import read_turtle, write_turtle


def read_tsv(spark: SparkSession, path: str, columns: list[str], least: int | None = None) -> DataFrame:
    """Trimmed cells of a tab-separated file without quoting; lines of fewer than ``least`` cells (all) are dropped, further
    cells ignored."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(cells) >= (least or len(columns)))
    return rows.select(*[F.trim(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)])


def write_tsv(rows: DataFrame, path: str, *columns: str, order: list[str] | None = None) -> None:
    """Columns as tab-separated lines, in ``order`` if given. Tabs and line breaks in cells become spaces."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in columns]
    (rows.orderBy(*order) if order else rows).select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id, uri; uris in normal form C."""
    return read_tsv(spark, path, ["id", "uri"]).select(F.col("id").try_cast("long").alias("id"), nfc("uri").alias("uri"))


def read_attr_names(spark: SparkSession, path: str, kg: int) -> DataFrame:
    rows = read_tsv(spark, path, ["p", "label"], least=1)
    return rows.select(F.lit(kg).alias("kg"), "p", F.coalesce(F.nullif("label", F.lit("")), F.element_at(F.split("p", "/"), -1)).alias("label"))


def read_attr_match(spark: SparkSession, path: str) -> DataFrame:
    """p1, p2: the cross product of both lists of a line; comments and lines of other shapes are dropped."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#")).where(F.size(F.split(F.trim("value"), "\t")) == 2)
    sides = lines.select(F.split(F.trim("value"), "\t").alias("s"))
    return sides.select(F.explode(F.split(F.col("s")[0], ",")).alias("p1"), "s").select(F.trim("p1").alias("p1"), F.explode(F.split(F.col("s")[1], ",")).alias("p2")).select("p1", F.trim("p2").alias("p2"))


def read_graph(spark: SparkSession, folder: str, kg: int) -> DataFrame:
    """Triples of a graph with integer relation triples and URI attribute triples; unknown ids are dropped."""
    ents, rels = read_ids(spark, f"{folder}/ent_ids_{kg}"), read_ids(spark, f"{folder}/rel_ids_{kg}")
    raw = read_tsv(spark, f"{folder}/triples_{kg}", ["s", "p", "o"]).select(*[F.col(c).try_cast("long").alias(c) for c in "spo"])
    rel = raw.join(ents.toDF("s", "su"), "s").join(ents.toDF("o", "ou"), "o").join(rels.toDF("p", "pu"), "p").select(F.lit(kg).alias("kg"), F.col("su").alias("s"), F.col("pu").alias("p"), F.col("ou").alias("o"), F.lit("uri").alias("o_kind"))
    attr = read_tsv(spark, f"{folder}/attr_triples{kg}", ["s", "p", "o"]).select(F.lit(kg).alias("kg"), nfc("s").alias("s"), "p", "o", F.lit("lit").alias("o_kind"))
    return rel.unionByName(attr).distinct()


def read_uri_graph(spark: SparkSession, folder: str, kg: int) -> DataFrame:
    """Triples of a graph with URI relation triples and attribute triples whose subject is an id."""
    ents = read_ids(spark, f"{folder}/ent_ids_{kg}")
    rel = read_tsv(spark, f"{folder}/{'st'[kg - 1]}_triples.txt", ["s", "p", "o"]).select(F.lit(kg).alias("kg"), nfc("s").alias("s"), "p", nfc("o").alias("o"), F.lit("uri").alias("o_kind"))
    attr = read_tsv(spark, f"{folder}/attr_triples_{kg}", ["id", "p", "o"]).withColumn("id", F.col("id").try_cast("long")).join(ents, "id").select(F.lit(kg).alias("kg"), F.col("uri").alias("s"), "p", "o", F.lit("lit").alias("o_kind"))
    return rel.unionByName(attr).distinct()


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """e1, e2, split from the id pair files that exist; pairs of unknown ids are dropped."""
    one, two = read_ids(spark, f"{folder}/ent_ids_1").toDF("i", "e1"), read_ids(spark, f"{folder}/ent_ids_2").toDF("j", "e2")
    parts = [read_tsv(spark, f"{folder}/{s}_pairs", ["i", "j"]).withColumn("split", F.lit(s)) for s in ("sup", "ref", "valid") if _exists(spark, f"{folder}/{s}_pairs")]
    if not parts:
        return spark.createDataFrame([], "e1 string, e2 string, split string")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.select(F.col("i").try_cast("long").alias("i"), F.col("j").try_cast("long").alias("j"), "split")
    return rows.join(one, "i").join(two, "j").select("e1", "e2", "split")


@READERS.register("openea")
def read_openea(spark: SparkSession, folder: str, readers=(read_graph, read_uri_graph)) -> Dataset:
    """A dataset folder: of the layouts whose files exist, the one with most triples."""
    found = []
    for reader, sub, marker in zip(readers, ("attribute_data", "knowformer_data"), ("triples_1", "s_triples.txt"), strict=True):
        place = f"{folder}/{sub}"
        if _exists(spark, f"{place}/{marker}"):
            triples = reader(spark, place, 1).unionByName(reader(spark, place, 2))
            found.append((triples, place))
    if not found:
        raise FileNotFoundError(f"no known layout in {folder}")
    triples, place = max(found, key=lambda x: x[0].count()) if len(found) > 1 else found[0]
    ids = f"{folder}/attribute_data" if _exists(spark, f"{folder}/attribute_data/ent_ids_1") else place
    return _dataset(spark, triples, ids)


def _dataset(spark: SparkSession, triples: DataFrame, folder: str) -> Dataset:
    match = read_attr_match(spark, f"{folder}/match_attr") if _exists(spark, f"{folder}/match_attr") else spark.createDataFrame([], "p1 string, p2 string")
    names = [read_attr_names(spark, f"{folder}/attr_names{k}", k) for k in (1, 2) if _exists(spark, f"{folder}/attr_names{k}")]
    labels = names[0] if names else spark.createDataFrame([], "kg int, p string, label string")
    for more in names[1:]:
        labels = labels.unionByName(more)
    test = read_fixed_test(spark, f"{folder}/fixed_test_pairs.json") if _exists(spark, f"{folder}/fixed_test_pairs.json") else None
    return Dataset(triples, read_pairs(spark, folder).select("e1", "e2").distinct(), match, labels, test)


@READERS.register("bert_int")
def read_integer_layout(spark: SparkSession, folder: str) -> Dataset:
    """A flat folder of the integer layout; missing alignment files are no pairs."""
    return _dataset(spark, read_graph(spark, folder, 1).unionByName(read_graph(spark, folder, 2)), folder)


NT = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*+)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str, kg: int) -> DataFrame:
    """Triples of an N-Triples file; comments and other lines are dropped, language and type marks too. Blank nodes and
    ``\\U`` escapes are read by ``turtle.read_turtle``, of which N-Triples is a part."""
    part = lambda n: F.regexp_extract("value", NT, n)
    # The escapes are those of JSON.
    quoted = F.from_json(F.concat(F.lit('{"v":"'), part(4), F.lit('"}')), "v string", {"allowUnquotedControlChars": "true"})["v"]
    unescaped = F.when(F.contains(part(4), F.lit("\\")), F.coalesce(quoted, part(4))).otherwise(part(4))
    rows = spark.read.text(path).where(F.col("value").rlike(NT))
    return rows.select(F.lit(kg).alias("kg"), part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(unescaped).alias("o"), F.when(part(3) != "", "uri").otherwise("lit").alias("o_kind")).distinct()


@READERS.register("rdf")
def read_rdf(spark: SparkSession, folder: str) -> Dataset:
    """Each graph from its N-Triples file, or from its Turtle file where there is none of N-Triples."""
    def graph(name: str, kg: int) -> DataFrame:
        plain = f"{folder}/{name}.nt"
        return read_ntriples(spark, plain, kg) if _exists(spark, plain) else read_turtle(spark, f"{folder}/{name}.ttl", kg)

    triples = graph("graph_source", 1).unionByName(graph("graph_target", 2))
    return Dataset(triples, read_tsv(spark, f"{folder}/aligned_entities.tsv", ["e1", "e2"]).distinct(), spark.createDataFrame([], "p1 string, p2 string"))


def ntriples_line(o_kind: Column) -> Column:
    escaped = F.col("o")
    for plain, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(escape))
    obj = F.when(o_kind == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))
    return F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, F.lit(" ."))


@WRITERS.register("rdf")
def write_rdf(data: Dataset, folder: str, form: str = "nt", prefixes: dict[str, str] | None = None) -> None:
    """``form`` is nt (N-Triples) or ttl (Turtle, with names shortened by ``prefixes``)."""
    for kg, name in ((1, "graph_source"), (2, "graph_target")):
        if form == "ttl":
            write_turtle(data.graph(kg), f"{folder}/{name}.ttl", prefixes or {})
        else:
            data.graph(kg).select(ntriples_line(F.col("o_kind")).alias("value")).write.mode("overwrite").text(f"{folder}/{name}.nt")
    write_tsv(data.alignment, f"{folder}/aligned_entities.tsv", "e1", "e2", order=["e1", "e2"])


def _relation_ids(triples: DataFrame) -> DataFrame:
    """kg, p, id in order of the names; graph 2 after graph 1."""
    used = relation_triples(triples).select("kg", "p").distinct().withColumn("_k", F.concat(F.col("kg").cast("string"), "p"))
    return global_row_number(used, ["_k"], "id").select("kg", "p", (F.col("id") - 1).alias("id"))


def _encoded(data: Dataset) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids, rels = first_seen_ids(data.triples), _relation_ids(data.triples)
    rel = relation_triples(data.triples).join(ids.toDF("kg", "s", "si"), ["kg", "s"]).join(ids.toDF("kg", "o", "oi"), ["kg", "o"]).join(rels.toDF("kg", "p", "pi"), ["kg", "p"])
    return ids, rels, rel


def write_integer_layout(data: Dataset, folder: str, splits: DataFrame | None = None) -> None:
    """ids in order of first occurrence, integer relation triples, URI attribute triples, pairs by split, matches and names."""
    ids, rels, rel = _encoded(data)
    for kg in (1, 2):
        own = F.col("kg") == kg
        write_tsv(ids.where(own), f"{folder}/ent_ids_{kg}", "id", "entity", order=["id"])
        write_tsv(rels.where(own), f"{folder}/rel_ids_{kg}", "id", "p", order=["id"])
        write_tsv(rel.where(own), f"{folder}/triples_{kg}", "si", "pi", "oi", order=["si", "pi", "oi"])
        write_tsv(attribute_triples(data.triples).where(own), f"{folder}/attr_triples{kg}", "s", "p", "o", order=["s", "p", "o"])
        if data.attr_names is not None:
            write_tsv(data.attr_names.where(own), f"{folder}/attr_names{kg}", "p", "label", order=["p"])
    numbered = (splits if splits is not None else split_positions(data.alignment)).join(ids.where("kg = 1").select(F.col("entity").alias("e1"), F.col("id").alias("i")), "e1").join(ids.where("kg = 2").select(F.col("entity").alias("e2"), F.col("id").alias("j")), "e2")
    for split in ("sup", "ref", "valid"):
        write_tsv(numbered.where(F.col("split") == split), f"{folder}/{split}_pairs", "i", "j", order=["i", "j"])
    write_attr_match(data.attr_match, f"{folder}/match_attr")
    if data.fixed_test is not None:
        write_pairs_json(data.fixed_test, f"{folder}/fixed_test_pairs.json", {})


@WRITERS.register("bert_int")
def write_bert_int(data: Dataset, folder: str) -> None:
    write_integer_layout(data, folder)


def write_uri_layout(data: Dataset, folder: str) -> None:
    """URI relation triples, id attribute triples, vocabulary, URI pairs and masked training triples."""
    ids = first_seen_ids(data.triples)
    for kg in (1, 2):
        write_tsv(ids.where(F.col("kg") == kg), f"{folder}/ent_ids_{kg}", "id", "entity", order=["id"])
        write_tsv(relation_triples(data.graph(kg)), f"{folder}/{'st'[kg - 1]}_triples.txt", "s", "p", "o", order=["s", "p", "o"])
        write_tsv(attribute_triples(data.graph(kg)).join(ids.toDF("kg", "s", "id"), ["kg", "s"]), f"{folder}/attr_triples_{kg}", "id", "p", "o", order=["id", "p", "o"])
    splits = split_positions(data.alignment)
    write_tsv(splits, f"{folder}/ent_ILLs.txt", "e1", "e2", order=["e1", "e2"])
    for split in ("sup", "ref", "valid"):
        write_tsv(splits.where(F.col("split") == split), f"{folder}/{split}_ents.txt", "e1", "e2", order=["e1", "e2"])
    merged = merged_triples(data)
    write_tsv(vocabulary(merged.select(F.lit(1).alias("kg"), "s", "p", "o", F.lit("uri").alias("o_kind"))), f"{folder}/vocab.txt", "token", order=["id"])
    write_tsv(masked(equivalence_expansion(merged, splits.where("split <> 'sup'"))), f"{folder}/train.triples.txt", "s", "p", "o", "mask")


@WRITERS.register("openea")
def write_openea(data: Dataset, folder: str) -> None:
    write_integer_layout(data, f"{folder}/attribute_data")
    write_uri_layout(data, f"{folder}/knowformer_data")


def write_attr_match(match: DataFrame, path: str) -> None:
    write_tsv(match.groupBy("p1").agg(F.array_join(F.sort_array(F.collect_list("p2")), ",").alias("p2")), path, "p1", "p2", order=["p1"])


def read_fixed_test(spark: SparkSession, path: str) -> DataFrame:
    """e1, e2 of a file {pairs: [[e1, e2], ...], ...}."""
    rows = spark.read.schema("pairs array<array<string>>").json(path, multiLine=True)
    return rows.select(F.explode("pairs").alias("p")).select(F.col("p")[0].alias("e1"), F.col("p")[1].alias("e2"))


def write_pairs_json(pairs: DataFrame, path: str, extra: dict) -> None:
    """One JSON object with the pairs: the layout asks for one row, so this is for test sets, not for graphs."""
    row = pairs.agg(F.sort_array(F.collect_list(F.array("e1", "e2"))).alias("pairs"), F.count(F.lit(1)).alias("count"))
    row.withColumns({k: F.lit(v) for k, v in extra.items()}).write.mode("overwrite").json(path)


def write_supervision(roles: DataFrame, path: str, seed: int) -> None:
    lists = [F.sort_array(F.collect_list(F.when(F.col("role") == r, F.array("e1", "e2")))).alias(r) for r in ("pool", "test")]
    sizes = [F.count(F.when(F.col("role") == r, 1)).alias(f"{r}_size") for r in ("pool", "test")]
    roles.agg(*lists, *sizes).withColumn("seed", F.lit(seed)).write.mode("overwrite").json(path)


def read_supervision(spark: SparkSession, path: str) -> DataFrame:
    """e1, e2, role; raises if a pair is in both roles."""
    rows = spark.read.schema("pool array<array<string>>, test array<array<string>>").json(path, multiLine=True)
    parts = [rows.select(F.explode(r).alias("p"), F.lit(r).alias("role")) for r in ("pool", "test")]
    out = parts[0].unionByName(parts[1]).select(F.col("p")[0].alias("e1"), F.col("p")[1].alias("e2"), "role")
    both = out.groupBy("e1", "e2").agg(F.countDistinct("role").alias("n")).where("n > 1")
    if not both.isEmpty():
        raise ValueError("pool and test overlap")
    return out


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """path, model, metric, value of results files {model: {metric: number, ...}}; values that are no numbers are dropped."""
    rows = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,map<string,string>>").alias("m"))
    models = rows.select("path", F.explode("m").alias("model", "values"))
    return models.select("path", "model", F.explode("values").alias("metric", "v")).select("path", "model", "metric", F.col("v").try_cast("double").alias("value")).where("value is not null")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def file_times(spark: SparkSession, pattern: str) -> DataFrame:
    """folder, first, last, seconds: least and greatest modification time of the files of each folder, never negative."""
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "modificationTime")
    out = files.groupBy("folder").agg(F.min("modificationTime").alias("first"), F.max("modificationTime").alias("last"))
    return out.withColumn("seconds", (F.col("last").cast("double") - F.col("first").cast("double")))


def stage_times(spark: SparkSession, pattern: str, result: str = "results.json") -> DataFrame:
    """folder, start, end, seconds of stage folders, from the times of their files alone: no content is read.

    A stage ends when its ``result`` was last written, or else its last file; it starts with its first file. In copied
    folders that may lie behind the end: such a stage starts and ends at once. Folders have no time of birth in a store
    that Spark reads, so the first file stands for it.
    """
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "modificationTime")
    times = files.groupBy("folder").agg(F.min("modificationTime").alias("first"), F.max("modificationTime").alias("last"), F.max(F.when(F.col("name") == result, F.col("modificationTime"))).alias("written"))
    times = times.withColumn("end", F.coalesce("written", "last")).withColumn("start", F.least("first", "end"))
    return times.select("folder", "start", "end", (F.col("end").cast("double") - F.col("start").cast("double")).alias("seconds"))


def missing_files(expected: DataFrame, spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of ``expected`` (path, relative end of a file's path) that no file ends in."""
    found = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("found"))
    names = found.select(F.element_at(F.split("found", "/"), -1).alias("name"), F.element_at(F.split("found", "/"), -2).alias("folder"))
    return expected.join(names.select(F.concat_ws("/", "folder", "name").alias("path")), "path", "left_anti")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """token, embedding of a text file of a token and its numbers; a header line and broken lines are dropped."""
    cells = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).where(F.size(cells) > 2).select(F.get(cells, F.lit(0)).alias("token"), F.transform(F.slice(cells, F.lit(2), F.size(cells) - 1), lambda x: x.try_cast("double")).alias("embedding"))
    return rows.where(~F.exists("embedding", lambda x: x.isNull()))


def read_attribute_lines(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of attribute lines: three cells, the predicate's last segment, values without marks and types."""
    cells = F.split("value", "\t", 3)
    rows = spark.read.text(path).where(F.size(cells) == 3)
    segment = lambda c: F.regexp_extract(F.regexp_replace(c, "[<>]", ""), "([^/#]*)$", 1)
    return rows.select(F.regexp_replace(F.get(cells, F.lit(0)), "[<>]", "").alias("s"), segment(F.get(cells, F.lit(1))).alias("p"), X.parse_object(F.regexp_replace(F.get(cells, F.lit(2)), r"\s*\.\s*$", "")).alias("o"))


def inject_triples(triples: DataFrame, more: DataFrame) -> DataFrame:
    """Set union of a graph with further triples."""
    return triples.unionByName(more.select(triples.columns)).distinct()


def re_encode(spark: SparkSession, source: str, target: str) -> None:
    """Triples of URIs and pairs of ids as a model reads them: integers parted by spaces, and a vocabulary.

    ``source`` has ent_ids_1 and _2, rel_ids_1 and _2, triples_1 and _2, sup_pairs and ref_pairs. Relations of the second graph
    are numbered behind those of the first. An entity in both lists has its later number; triples with an unknown part are
    left out. The vocabulary holds entities, then relations, by number.
    """
    def numbered(name: str) -> DataFrame:
        parts = [read_tsv(spark, f"{source}/{name}_{kg}", ["id", "uri"]).select(F.lit(kg).alias("kg"), F.col("id").try_cast("long").alias("id"), "uri") for kg in (1, 2) if _exists(spark, f"{source}/{name}_{kg}")]
        out = spark.createDataFrame([], "kg int, id long, uri string")
        for part in parts:
            out = out.unionByName(part.where("id is not null"))
        return out

    entities = numbered("ent_ids").groupBy("uri").agg(F.max(F.struct("kg", "id"))["id"].alias("id"))
    relations = numbered("rel_ids")
    behind = F.broadcast(relations.where("kg = 1").agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("_behind")))
    relations = relations.crossJoin(behind).select("kg", "uri", (F.col("id") + F.when(F.col("kg") == 2, F.col("_behind")).otherwise(0)).alias("id"))
    spaced = lambda rows, path, *cells: rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cells]).alias("value")).write.mode("overwrite").text(path)
    for kg in (1, 2):
        if _exists(spark, f"{source}/triples_{kg}"):
            rows = read_tsv(spark, f"{source}/triples_{kg}", ["s", "p", "o"]).join(entities.toDF("s", "si"), "s").join(entities.toDF("o", "oi"), "o")
            spaced(rows.join(relations.where(F.col("kg") == kg).select(F.col("uri").alias("p"), F.col("id").alias("pi")), "p"), f"{target}/triples_{kg}", "si", "pi", "oi")
    for name in ("sup_pairs", "ref_pairs"):
        if _exists(spark, f"{source}/{name}"):
            spaced(read_tsv(spark, f"{source}/{name}", ["a", "b"]), f"{target}/{name}", "a", "b")
    words = entities.select(F.lit(0).alias("_k"), "id", "uri").unionByName(relations.groupBy("uri").agg(F.max(F.struct("kg", "id"))["id"].alias("id")).select(F.lit(1).alias("_k"), "id", "uri"))
    write_tsv(words, f"{target}/vocab.txt", "id", "uri", order=["_k", "id"])


def with_name_vectors(names: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """id, embedding: a name's vector, or numbers in [-1, 1) from its hash where there is none."""
    digits = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("|", "id", i.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**31 - 1)
    made = F.transform(F.sequence(F.lit(1), F.lit(width)), digits)
    return names.join(vectors.select(F.col("token").alias("name"), "embedding"), "name", "left").select("id", F.coalesce("embedding", made).alias("embedding"))


def write_table(rows: DataFrame, path: str, form: str = "csv") -> None:
    """csv, tsv, md (a Markdown table) or tex (a LaTeX table with escaped cells)."""
    if form == "tex":
        cells = [latex_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns]
        lines = rows.select(F.monotonically_increasing_id().alias("at"), F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("value"))
        spark = rows.sparkSession
        names = spark.range(1).select(F.concat(F.concat_ws(" & ", *[latex_escape(F.lit(c)) for c in rows.columns]), F.lit(" \\\\"))).first()[0]
        edge = lambda at, texts: spark.createDataFrame([(at + i, t) for i, t in enumerate(texts)], "at long, value string")
        head = edge(-9, ["\\begin{tabular}{" + "l" * len(rows.columns) + "}", "\\toprule", names, "\\midrule"])
        tail = edge(2**62, ["\\bottomrule", "\\end{tabular}"])
        head.unionByName(lines).unionByName(tail).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
    elif form == "md":
        head = ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
        lines = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |")).alias("value"))
        spark = rows.sparkSession
        spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(lines).coalesce(1).write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").options(header=True, sep="\t" if form == "tsv" else ",").csv(path)
