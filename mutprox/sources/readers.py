"""Readers and writers of the tables. Text formats are read once into typed columns; Parquet is what jobs pass on."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mutprox.functions import columns as C
from mutprox.session import cut, new_path

#: Required headers of the text formats and the names used here.
MAF = {
    "Hugo_Symbol": "gene", "Chromosome": "chromosome", "Start_Position": "start_pos", "End_Position": "stop_pos", "Variant_Classification": "classification",
    "Reference_Allele": "ref", "Tumor_Seq_Allele2": "alt", "Tumor_Sample_Barcode": "sample",
}
SIDE = {"Chain": "chain", "Position": "position", "Feature": "feature", "COSMIC": "cosmic"}
MUTATION = {"Gene": "gene", "Chromosome": "chromosome", "Start": "start", "Stop": "stop", "Mutation": "mutation", **SIDE}
SITE = {"Gene": "gene", "Transcript": "transcript", "TranscriptPosition": "transcript_position", "Site": "site", **SIDE}
PAIRS = {"pairwise": (MUTATION, MUTATION), "musites": (MUTATION, SITE), "sites": (SITE, SITE)}
DRUGS = {
    "Drug": "drug", "Drugport_ID": "drug_id", "PDB_ID": "pdb", "Compound_Location": "location", "Gene": "gene", "Chromosome": "chromosome", "Start": "start",
    "Stop": "stop", "Amino_Acid_Change": "mutation", "Mutation_Location_In_PDB": "position", "Domain_Annotation": "feature", "Cosmic_Annotation": "cosmic",
    "Linear_Distance_Between_Drug_and_Mutation": "linear_distance", "3D_Distance_Information": "info",
}
PROXIMITY = ("uniprot1", "chain1", "pos1", "off1", "name1", "uniprot2", "chain2", "pos2", "off2", "name2", "distance", "pdb")
#: Feature types that are no places of interest.
SKIPPED_FEATURES = ("CONFLICT", "STRAND", "HELIX", "TURN", "VAR_SEQ", "INIT_MET", "VARIANT", "CHAIN")


def _tsv(spark: SparkSession, path: str, **more: str) -> DataFrame:
    return spark.read.options(sep="\t", header="true", quote='"', mode="PERMISSIVE", **more).csv(path)


def _need(df: DataFrame, names: list[str], path: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")


def _number(c: Column, kind: str) -> Column:
    return F.trim(c).try_cast(kind)


def read_maf(spark: SparkSession, path: str, transcript_col: str = "transcript_name", aa_col: str = "amino_acid_change", weight_col: str | None = None) -> DataFrame:
    """Mutation calls; rows too short to have the transcript and change columns go. ``line_no`` grows along each file."""
    df = _tsv(spark, path, comment="#")
    _need(df, [*MAF, transcript_col, aa_col, *([weight_col] if weight_col else [])], path)
    out = [F.col(k).alias(v) for k, v in MAF.items()] + [F.col(transcript_col).alias("transcript"), F.col(aa_col).alias("aa_change")]
    out.append(_number(F.col(weight_col), "double").alias("weight") if weight_col else F.lit(None).cast("double").alias("weight"))
    rows = df.filter(F.col(transcript_col).isNotNull() & F.col(aa_col).isNotNull()).select(*out, F.monotonically_increasing_id().alias("line_no"))
    return rows.withColumn("start_pos", _number(F.col("start_pos"), "long")).withColumn("stop_pos", _number(F.col("stop_pos"), "long"))


def read_pairs(spark: SparkSession, path: str, kind: str = "pairwise") -> DataFrame:
    """Pairs of one kind: pairwise, musites, sites or drugs; the info list is decoded, ``N/A`` linear distances are null."""
    df = _tsv(spark, path)
    if kind == "drugs":
        _need(df, ["Drug", "Gene", "3D_Distance_Information"], path)
        chain = lambda names: F.coalesce(*[F.col(n) for n in names if n in df.columns])
        cols = [F.col(k).alias(v) for k, v in DRUGS.items() if k in df.columns and v not in ("info", "linear_distance")]
        cols += [C.strip_chain(chain(["Drug_Chain", "Chain1"])).alias("chain1"), C.strip_chain(chain(["Res_Chain", "Chain2"])).alias("chain2")]
        return df.select(*cols, C.decode_info(F.col("3D_Distance_Information")).alias("info"))
    one, two = PAIRS[kind]
    names = [f"{k}1" for k in one] + [f"{k}2" for k in two] + ["LinearDistance", "DistanceInfo"]
    _need(df, names, path)
    side = lambda part, n: [(C.strip_chain(F.col(f"{k}{n}")) if v == "chain" else F.col(f"{k}{n}")).alias(f"{v}{n}") for k, v in part.items()]
    return df.select(*side(one, 1), *side(two, 2), _number(F.col("LinearDistance"), "int").alias("linear_distance"), C.decode_info(F.col("DistanceInfo")).alias("info"))


def read_sites(spark: SparkSession, path: str, transcript_col: str = "transcript_name") -> DataFrame:
    df = _tsv(spark, path)
    _need(df, ["Hugo_Symbol", transcript_col, "Position", "Feature"], path)
    return df.select(F.col("Hugo_Symbol").alias("gene"), F.col(transcript_col).alias("transcript"), _number(F.col("Position"), "int").alias("position"), F.col("Feature").alias("feature"))


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """``gene, uniprot, pdbs, aliases, segments_text`` without genes that have no protein or structure."""
    df = spark.read.options(sep="\t").csv(path)
    cols = [F.col(c) for c in df.columns] + [F.lit(None).cast("string")] * (5 - len(df.columns))
    rows = df.select(*[c.alias(n) for c, n in zip(cols, ("gene", "uniprot", "pdb", "alias", "segments_text"))])
    rows = rows.filter((F.col("pdb") != "N/A") & (F.trim(F.coalesce("uniprot", F.lit(""))) != ""))
    names = lambda c: F.array_remove(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), "")
    return rows.select("gene", "uniprot", names("pdb").alias("pdbs"), names("alias").alias("aliases"), "segments_text")


def gene_structures(gene_map: DataFrame) -> DataFrame:
    return gene_map.select("gene", "uniprot", F.explode("pdbs").alias("pdb")).distinct()


def parse_segments(gene_map: DataFrame) -> DataFrame:
    """``ENST[ubeg|tbeg-uend|tend:...]`` lists as rows: transcript, uniprot, t_begin, t_end, u_begin, u_end."""
    each = gene_map.select("uniprot", F.explode(F.regexp_extract_all("segments_text", F.lit(r"(\w+\[[^\]]*\])"))).alias("t"))
    each = each.select("uniprot", F.regexp_extract("t", r"^(\w+)\[", 1).alias("transcript"), F.explode(F.split(F.regexp_extract("t", r"\[(.*)\]", 1), ":")).alias("s"))
    p = r"(\d+)\|(\d+)-(\d+)\|(\d+)"
    n = lambda k: F.regexp_extract("s", p, k).try_cast("long")
    return each.select("transcript", "uniprot", n(2).alias("t_begin"), n(4).alias("t_end"), n(1).alias("u_begin"), n(3).alias("u_end")).filter("t_begin is not null")


def check_proximity(raw: DataFrame) -> DataFrame:
    """Proximity rows, all strings, with ``reason``: null if sound, else what is incomplete (coordinate, protein or proximity)."""
    chain = lambda c: F.coalesce(F.col(c).rlike(r"^\[[A-Z]\]$"), F.lit(False))
    protein = lambda c: F.coalesce(F.col(c).rlike(r"^\w+$"), F.lit(False))
    number = lambda c, kind: F.col(c).try_cast(kind).isNotNull()
    reason = (
        F.when(~(protein("uniprot1") & protein("uniprot2")), "protein")
        .when(~(chain("chain1") & chain("chain2") & number("pos1", "int") & number("pos2", "int")), "coordinate")
        .when(~(number("distance", "double") & F.col("pdb").isNotNull()), "proximity")
    )
    return raw.withColumn("reason", reason)


def sound_proximity(checked: DataFrame) -> DataFrame:
    typed = {"pos1": "int", "off1": "int", "pos2": "int", "off2": "int", "distance": "double"}
    cols = [F.col(c).try_cast(typed[c]).alias(c) if c in typed else C.strip_chain(F.col(c)).alias(c) if c.startswith("chain") else F.col(c) for c in PROXIMITY]
    return checked.filter("reason is null").select(*cols)


def read_proximity(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sound rows, typed, and the rejected ones with their reason; headers and ``WARNING:`` lines are neither."""
    raw = spark.read.options(sep="\t").csv(path)
    raw = raw.select(*[F.col(c).alias(n) for c, n in zip(raw.columns, PROXIMITY)])
    raw = raw.filter(~F.coalesce(F.col("uniprot1").rlike("^(WARNING:|UniProt_ID1)"), F.lit(False)))
    checked = check_proximity(raw)
    return sound_proximity(checked), checked.filter("reason is not null")


#: Columns of collapsed and annotated pairs.
PRIORITISED = tuple(f"{c}{n}" for n in (1, 2) for c in ("uniprot", "chain", "pos", "off", "name", "feature", "cosmic"))


def read_prioritised(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Collapsed pairs with features and known changes: sound rows, typed, and the rejected ones with their ``reason``.

    A row lacks what is empty in it: coordinates first, then protein, proximity and annotation. Headers are neither.
    """
    raw = spark.read.options(sep="\t").csv(path)
    raw = raw.select(*[F.col(c).alias(n) for c, n in zip(raw.columns, (*PRIORITISED, "info"))]).filter(~F.coalesce(F.col("uniprot1").rlike("^(WARNING:|UniProt_ID1)"), F.lit(False)))
    lacks = lambda *names: F.greatest(*[F.col(f"{c}{n}").isNull() for c in names for n in (1, 2)])
    reason = F.when(lacks("pos", "off", "chain"), "coordinate").when(lacks("uniprot", "name"), "protein").when(F.col("info").isNull(), "proximity").when(lacks("feature", "cosmic"), "annotation")
    checked = raw.withColumn("reason", reason)
    typed = [F.col(c).try_cast("int").alias(c) if c[:3] in ("pos", "off") else C.strip_chain(F.col(c)).alias(c) if c.startswith("chain") else F.col(c) for c in PRIORITISED]
    return checked.filter("reason is null").select(*typed, C.decode_info(F.col("info")).alias("info")), checked.filter("reason is not null")


def read_cosmic(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.options(sep="\t").csv(path).toDF("gene", "transcript", "type", "aa_change", "domain", "tissue")
    return df.filter(F.col("gene") != "gene_name")


def read_features(spark: SparkSession, path: str, uniprot: str) -> DataFrame:
    """Features of one protein: start, end, type, description; quotes go."""
    df = spark.read.options(sep="\t", quote="").csv(path).toDF("start_pos", "end_pos", "type", "description")
    bare = [F.regexp_replace(c, '"', "").alias(c) for c in ("type", "description")]
    return df.select(F.lit(uniprot).alias("uniprot"), _number(F.col("start_pos"), "int").alias("start_pos"), _number(F.col("end_pos"), "int").alias("end_pos"), *bare, F.monotonically_increasing_id().alias("line_no"))


def parse_protein_records(text_df: DataFrame) -> dict[str, DataFrame]:
    """UniProt flat text (uniprot, text) as tables: structures, transcripts, features and sequences."""
    lines = text_df.select("uniprot", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    part = lambda p, *names: lines.filter(F.col("line").rlike(p)).select("uniprot", "line_no", *[F.regexp_extract("line", p, k + 1).alias(n) for k, n in enumerate(names)])
    ft = part(r"^FT   (\S+)\s+<?(\d+)\s+>?(\d+)\s*(.*?)\s*$", "type", "start_pos", "end_pos", "description").filter(~F.col("type").isin(list(SKIPPED_FEATURES)))
    seq = lines.filter(F.col("line").rlike(r"^     ")).groupBy("uniprot").agg(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace("line", r"\s", "").alias("s")))).alias("p"))
    return {
        "structures": part(r"^DR   PDB;\s*(\w+);\s*([^;]*);\s*([^;]*);\s*(.*?)\.?\s*$", "pdb", "method", "resolution", "chains").drop("line_no"),
        "transcripts": part(r"^DR   Ensembl;\s*(\w+)[^;]*;\s*(\w+)[^;]*;\s*(\w+)", "transcript", "protein", "gene").drop("line_no"),
        "features": ft.withColumn("start_pos", F.col("start_pos").cast("int")).withColumn("end_pos", F.col("end_pos").cast("int")),
        "sequences": seq.select("uniprot", F.array_join("p.s", "").alias("sequence")),
    }


def parse_drug_records(text_df: DataFrame) -> DataFrame:
    """``KEY[i][j] value`` lines (drug, text) as one row for each drug and i_j with its target, non-target and unassigned structures."""
    p = r"^\s*(\w+)\[(\d+)\]\[(\d+)\]\s+(.*?)\s*$"
    g = lambda k: F.regexp_extract("line", p, k)
    rows = text_df.select("drug", F.explode(F.split("text", r"\r?\n")).alias("line")).filter(F.col("line").rlike(p))
    rows = rows.select("drug", g(1).alias("field"), F.concat_ws("_", g(2), g(3)).alias("slot"), g(4).alias("value"))
    fields = ["TARGET_PDB", "TARGET_CHAIN", "NONTARGET_PDB", "NONTARGET_CHAIN", "UNASSIGNED_PDB", "UNASSIGNED_CHAIN"]
    return rows.groupBy("drug", "slot").pivot("field", fields).agg(F.first("value")).toDF("drug", "slot", *[f.lower() for f in fields])


def parse_drug_table(df: DataFrame) -> DataFrame:
    """Comma lists ``pdb|chain|loc|het`` in ``targets`` and ``nontargets`` (``NULL``: none) as rows with ``is_target``."""
    p = r"^\s*([^|]+)\|([^|]*)\|([^|]*)\|?([^|]*)"
    g = lambda k: F.trim(F.regexp_extract("x", p, k))
    both = [df.select("drug", "drug_id", F.explode(F.split(c, ",")).alias("x"), F.lit(c == "targets").alias("is_target")).filter("x <> 'NULL' and x <> ''") for c in ("targets", "nontargets")]
    return both[0].unionByName(both[1]).filter(F.col("x").rlike(p)).select("drug", "drug_id", "is_target", F.upper(g(1)).alias("pdb"), g(2).alias("chain"), g(3).alias("location"), g(4).alias("het"))


def parse_gtf_cds(df: DataFrame) -> DataFrame:
    """CDS rows of GTF lines (feature, start, stop, attributes): gene, transcript, exon_no, length."""
    tag = lambda k: F.regexp_extract("attributes", rf'{k} "?([^";]+)"?', 1)
    return df.filter("feature = 'CDS'").select(tag("gene_name").alias("gene"), tag("transcript_id").alias("transcript"), tag("exon_number").try_cast("int").alias("exon_no"), (F.col("stop") - F.col("start") + 1).alias("length"))


def parse_gene_table(df: DataFrame) -> DataFrame:
    """Nomenclature rows (symbol, name, chromosome, previous, aliases): withdrawn ones and headers go, comma lists become arrays."""
    names = lambda c: F.array_remove(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""), ","), "")
    sound = df.filter(~F.lower(F.col("symbol")).contains("withdrawn") & (F.col("symbol") != "Approved Symbol"))
    return sound.select(F.regexp_replace("symbol", r"\s", "").alias("symbol"), "name", "chromosome", names("previous").alias("previous"), names("aliases").alias("aliases"))


CLUSTERS = {
    "Cluster": "cluster", "Gene/Drug": "gene", "Mutation/Gene": "mutation", "Degree_Connectivity": "degree", "Geodesic_From_Centroid": "geodesic", "Chromosome": "chromosome",
    "Start": "start", "Stop": "stop", "Reference": "ref", "Alternate": "alt", "Transcript": "transcript", "Alternative_Transcripts": "alternatives",
}


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster rows; the score may be a closeness or an exponential one, the weight a recurrence (``weight_is_recurrence`` tells)."""
    df = _tsv(spark, path)
    _need(df, list(CLUSTERS), path)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None)).cast("double")
    rows = df.select(*[F.col(k).alias(v) for k, v in CLUSTERS.items()], pick("Closeness_Centrality", "Exponentials_Score").alias("score"), pick("Weight", "Recurrence").alias("weight"), F.lit("Weight" not in df.columns).alias("weight_is_recurrence"), F.monotonically_increasing_id().alias("line_no"))
    return rows.withColumn("degree", F.col("degree").try_cast("double")).withColumn("geodesic", F.col("geodesic").try_cast("double"))


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''").distinct()


def distinct_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def line_numbers(ordered: DataFrame, name: str = "line") -> DataFrame:
    """The rows of a sorted frame with their place in it, from 1: numbers of a file follow on those of the files before it."""
    rows = cut(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a file
    starts = sizes.select("__part", before.alias("__before"))
    return rows.join(starts, part == F.col("__part")).withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet by default; ``tsv`` has a header, nulls as ``N/A`` and arrays encoded."""
    if format == "parquet":
        df.write.partitionBy(*partition_by).parquet(path)
        return
    flat = [C.encode_info(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.partitionBy(*partition_by).options(sep="\t", header="true", nullValue="N/A", emptyValue="").csv(path)


def write_bucketed(df: DataFrame, by: tuple[str, ...], name: str = "bucketed", buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table of its own in buckets by the hash of ``by``, sorted inside: joins and groups on ``by`` read it without a shuffle.

    There are as many buckets as shuffle partitions unless told otherwise, with one file each. The table is external: its
    files lie under ``path``, or in the shared folder.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or new_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(table)
    return spark.table(table)


def save_graph(vertices: DataFrame, edges: DataFrame, same_site: DataFrame, path: str) -> None:
    for name, df in (("vertices", vertices), ("edges", edges), ("same_site", same_site)):
        df.write.parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("vertices", "edges", "same_site"))
