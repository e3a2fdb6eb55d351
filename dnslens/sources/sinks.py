"""Writers for the file formats other tools of a measurement run read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import format_ip
from ..operators.joins import lpm_join
from ..operators.ranking import row_numbers
from ..schema import EMPTY, UNKNOWN

# Fixed value: how a report spells the question of a query.
OONI_QUERY = "[Query('<%s>',1,1)]"

# Fixed value: a report entry is closed once it holds more than this many queries.
OONI_ENTRY_LIMIT = 10_000


def _quoted(value: Column) -> Column:
    """A value as JSON. Braces in a string are escaped, so that readers can cut at those that are not."""
    text = F.to_json(F.array(value))
    inside = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.replace(F.replace(inside, F.lit("}"), F.lit("\\u007d")), F.lit("{"), F.lit("\\u007b"))


def _write_pieces(pieces: DataFrame, path: str) -> None:
    """Writes text pieces one after the other, a blank between them; lines end where a piece says so.

    A task streams its sorted pieces into its file, so a line may be longer than any task's memory, and
    Spark commits or drops the file of a task as a whole.
    """
    pieces.select("value").write.option("lineSep", " ").text(path)


def observation_pieces(obs: DataFrame, failures: DataFrame, domains: DataFrame) -> DataFrame:
    """``{name, failed, asn: {ip: n}}`` in pieces, a line for each domain, also for those without answers."""
    answers = obs.select(
        "domain",
        F.coalesce(F.col("resolver_asn").cast("string"), F.lit(UNKNOWN)).alias("asn"),
        F.coalesce(format_ip("answer_ip"), F.lit(EMPTY)).alias("ip"),
        "n",
        F.lit(None).cast("bigint").alias("failed"),
    )
    named = domains.select("domain").unionByName(obs.select("domain")).distinct()
    none = F.lit(None).cast("string")
    heads = named.join(failures.select("domain", "failed"), "domain", "left").select(
        "domain", none.alias("asn"), none.alias("ip"), F.lit(0).cast("bigint").alias("n"),
        F.coalesce(F.col("failed").cast("bigint"), F.lit(0)).alias("failed"),
    )
    # The head of a domain has no ASN and comes first.
    line = Window.partitionBy("domain").orderBy(F.col("asn").asc_nulls_first(), "ip")
    rows = answers.unionByName(heads).select(
        "*",
        F.lag("asn").over(line).alias("before"),
        F.lead("asn").over(line).alias("after"),
    )
    head = F.concat(F.lit('{"name":'), _quoted(F.col("domain")), F.lit(',"failed":'), F.col("failed").cast("string"))
    field = F.concat(F.lit(","), _quoted(F.col("asn")), F.lit(":{"))
    opened = F.when(F.col("before").eqNullSafe(F.col("asn")), F.lit(",")).otherwise(field)
    closed = F.when(F.col("after").eqNullSafe(F.col("asn")), F.lit("")).otherwise("}")
    answer = F.concat(opened, _quoted(F.col("ip")), F.lit(":"), F.col("n").cast("string"), closed)
    ended = F.when(F.col("after").isNull(), "}\n").otherwise("")
    return rows.select(F.concat(F.when(F.col("asn").isNull(), head).otherwise(answer), ended).alias("value"))


def write_observations(obs: DataFrame, failures: DataFrame, domains: DataFrame, path: str) -> None:
    _write_pieces(observation_pieces(obs, failures, domains), path)


def write_count_map(df: DataFrame, k1: str, k2: str, value: str, path: str) -> None:
    """``{k1: {k2: value}}`` lines, one for each ``k1`` however many values it has."""
    rows = df.select(F.col(k1).cast("string").alias("k1"), F.col(k2).cast("string").alias("k2"), F.col(value).alias("v"))
    line = Window.partitionBy("k1").orderBy("k2")
    first, last = F.lag("k1").over(line).isNull(), F.lead("k1").over(line).isNull()
    rows = rows.select("*", first.alias("first"), last.alias("last"))
    opened = F.when(F.col("first"), F.concat(F.lit("{"), _quoted(F.col("k1")), F.lit(":{"))).otherwise(",")
    entry = F.concat(opened, _quoted(F.col("k2")), F.lit(":"), _quoted(F.col("v")))
    pieces = rows.select(F.concat(entry, F.when(F.col("last"), "}}\n").otherwise("")).alias("value"))
    _write_pieces(pieces, path)


def ooni_records(
    responses: DataFrame,
    shard_domains: DataFrame,
    meta: dict[str, str],
    run_time: float,
    scan_time: float | DataFrame,
    now: float,
    limit: int = OONI_ENTRY_LIMIT,
) -> DataFrame:
    """Report records: a header, entries of up to ``limit + 1`` queries, a footer.

    ``responses`` holds ``shard, domain, seq, resolver_ip, addrs`` with at least one address
    each. Every domain of a shard ends with one entry, empty if nothing is left for it.
    ``scan_time`` is the start of all scans, or rows of ``shard, start_time``.
    """
    size = limit + 1
    numbered = row_numbers(responses, "seq", ["shard", "domain"])
    chunk = F.floor((F.col("rn") - 1) / size)
    full = numbered.groupBy("shard", "domain", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("rn", "resolver_ip", "addrs"))).alias("queries")
    )
    # What all queries of an entry share is added once they are together.
    full = full.withColumn("asked", F.format_string(OONI_QUERY, "domain"))
    query = lambda q: F.struct(
        q["rn"].alias("rn"),
        q["resolver_ip"].alias("resolver_ip"),
        F.lit(53).alias("resolver_port"),
        F.lit("A").alias("query_type"),
        F.col("asked").alias("query"),
        q["addrs"].alias("addrs"),
    )
    full = full.withColumn("queries", F.transform("queries", query)).drop("asked")
    counts = responses.groupBy("shard", "domain").agg(F.count(F.lit(1)).alias("c"))
    last = F.floor(F.coalesce("c", F.lit(0)) / size)
    slots = shard_domains.select("shard", "domain").join(counts, ["shard", "domain"], "left")
    slots = slots.select("shard", "domain", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    entries = slots.join(full, ["shard", "domain", "chunk"], "left").withColumn("part", F.lit(1))

    if isinstance(scan_time, DataFrame):
        starts = scan_time.select("shard", F.col("start_time").cast("double"))
        entries = entries.join(starts, "shard", "left")
    else:
        entries = entries.withColumn("start_time", F.lit(float(scan_time)))

    def common(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            "part",
            "shard",
            "chunk",
            *[F.lit(v).alias(k) for k, v in meta.items()],
            F.lit(kind).alias("record_type"),
            "start_time",
            F.lit("dns").alias("test_name"),
            F.lit("1.0.0").alias("test_version"),
            F.col("domain").alias("input"),
            "queries",
        )

    body = common(entries, "entry")
    spark = responses.sparkSession
    edge = spark.range(1).select(
        F.lit(None).cast("string").alias("shard"),
        F.lit(None).cast("bigint").alias("chunk"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast(body.schema["queries"].dataType).alias("queries"),
    )
    header = common(edge.withColumns({"part": F.lit(0), "start_time": F.lit(float(run_time))}), "header")
    footer = common(edge.withColumns({"part": F.lit(2), "start_time": F.lit(float(now))}), "footer")
    return header.unionByName(body).unionByName(footer)


def ooni_lines(records: DataFrame, meta: dict[str, str]) -> DataFrame:
    """Records as JSON text; the resolver becomes an ``[ip, port]`` pair of mixed type."""

    def as_text(q: Column) -> Column:
        return F.concat(
            F.lit('{"resolver":["'), q["resolver_ip"], F.lit('",'), q["resolver_port"].cast("string"),
            F.lit('],"query_type":"'), q["query_type"], F.lit('","query":"'), q["query"],
            F.lit('","addrs":'), F.to_json(q["addrs"]), F.lit("}"),
        )

    fields = [*meta, "record_type", "start_time", "test_name", "test_version", "input"]
    head = F.to_json(F.struct(*fields))
    queries = F.concat(F.lit("["), F.array_join(F.transform("queries", as_text), ","), F.lit("]"))
    line = F.when(
        F.col("queries").isNull(), head
    ).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"queries":'), queries, F.lit("}")))
    return records.select("part", "shard", "input", "chunk", line.alias("value"))


def write_ooni(records: DataFrame, meta: dict[str, str], path: str) -> None:
    """Text report in order: header first, footer last, across the part files."""
    order = ["part", "shard", "input", "chunk"]
    lines = ooni_lines(records, meta)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def split_by_asn(ips: DataFrame, prefixes: DataFrame, path: str) -> None:
    """One folder of addresses per ASN; addresses without one are dropped.

    ASNs are packed into few files by a rebalance that splits a very large ASN.
    """
    placed = lpm_join(ips, prefixes, "ip", "asn").filter("asn is not null").select("ip", "asn")
    placed.hint("rebalance", "asn").write.partitionBy("asn").parquet(path)


def write_resolver_list(df: DataFrame, path: str, fmt: str = "text", ip: str = "ip") -> None:
    """Selected resolvers as ``ip/32`` lines, or with ``fmt="json"`` as ``{ip: true}`` lines."""
    dotted = format_ip(ip)
    line = {"text": F.concat(dotted, F.lit("/32")), "json": F.to_json(F.create_map(dotted, F.lit(True)))}
    if fmt not in line:
        raise ValueError(f"unknown format {fmt!r}")
    df.select(line[fmt].alias("value")).write.text(path)
