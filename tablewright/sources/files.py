"""Run results, log lines, reports and settings documents in files."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..missing import quoted
from ..operators.params import with_params
from ..operators.runs import (
    BAD_JSON,
    DATE_WIDTH,
    REASON_WIDTH,
    STATUS_WIDTH,
    name_width,
    padded,
    report_rows,
    run_summary,
)

from ..session import materialize
from .batches import append_batch, published, read_batches

# Shape of one run-result document.
SCRIPT_RESULT = (
    "nome_script string, status string, inicio string, fim string, duracao_segundos double, "
    "codigo_saida bigint, saida_padrao string, saida_erro string, erro_tipo string, "
    "erro_mensagem string, erro_traceback string, tentativas bigint"
)
RUN_RESULT = (
    "nome_orquestrador string, status_geral string, inicio_execucao string, fim_execucao string, "
    "duracao_total_segundos double, total_scripts bigint, scripts_sucesso bigint, "
    "scripts_falha bigint, caminho_log string, "
    f"resultados_scripts array<struct<{SCRIPT_RESULT}>>"
)

# Fixed value: local files without a checksum file beside each, which takes as long to make as the file.
NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    """Run results, one JSON document per file, with ``path`` and ``status``.

    A document that cannot be read has the status ``erro_json`` and its text in ``corrupt``.
    """
    raw = (
        spark.read.schema(f"{RUN_RESULT}, corrupt string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .json(path)
    )
    status = F.when(F.col("corrupt").isNotNull(), BAD_JSON).otherwise(F.col("status_geral"))
    return raw.select(F.col("_metadata.file_path").alias("path"), "*", status.alias("status"))


def parse_run_results(docs: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """:func:`read_run_results` of documents that were read already, with their paths."""
    kept = T.StructType.fromDDL(f"{RUN_RESULT}, corrupt string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    parsed = docs.select(quoted(path).alias("path"), F.from_json(quoted(content), kept, options).alias("result"))
    status = F.when(F.col("corrupt").isNotNull(), BAD_JSON).otherwise(F.col("status_geral"))
    return parsed.select("path", "result.*").select("*", status.alias("status"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _text(content: Column) -> Column:
    """Bytes as text; those that are none are left out."""
    return F.when(F.is_valid_utf8(content), content).otherwise(
        F.replace(F.make_valid_utf8(content), F.lit("\ufffd"), F.lit(""))
    )


def _plain_path(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def scan_docs(spark: SparkSession, root: str, pattern: str = "settings.xml") -> DataFrame:
    """(``path``, ``content``) of all files of that name below ``root``.

    Bytes that are no text are left out.  For very many small files see :func:`pack_files`.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(_plain_path(F.col("_metadata.file_path")).alias("path"), _text(F.col("value")).alias("content"))


def write_documents(docs: DataFrame, path: str, folder: str, content: str = "value") -> None:
    """A text file for each row, in folders named by the column ``folder``.

    To make a file or folder takes far longer than to write its bytes, by which adaptive execution would
    leave all rows to one task.  Rows are dealt evenly, copies too, and then cut into ranges of folder and place:
    one for each shuffle partition of the session, so a task makes few folders.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(quoted(folder).alias("folder"), quoted(content).alias("value"))
    dealt = rows.repartition(tasks).withColumn("place", F.spark_partition_id())
    ranges = dealt.repartitionByRange(tasks, "folder", "place", F.xxhash64("value"))
    out = ranges.select(F.col("folder").alias(folder), F.col("value").alias(content))
    out.write.partitionBy(folder).options(**NO_CHECKSUMS).option("maxRecordsPerFile", 1).text(path)


def file_table(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(``path``, ``bytes``, ``modified``) of all files of that name below ``root``; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def pack_files(
    spark: SparkSession,
    root: str,
    target: str,
    batch: str,
    pattern: str = "settings.xml",
    task_bytes: int = 128 << 20,
    open_bytes: int = 32 << 10,
) -> bool:
    """Add the files below ``root`` that the packed table at ``target`` lacks, as one batch.

    Each file is opened once, by tasks of about ``task_bytes``, an opening counting as much as
    ``open_bytes``; a task writes one part of the table.  Later jobs read the table, whose parts follow
    the bytes and not the number of files.  A file counts as new if its path or its time of modification is.
    False if the batch is there already.
    """
    sizes = {"spark.sql.files.maxPartitionBytes": task_bytes, "spark.sql.files.openCostInBytes": open_bytes}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    new = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")
    if published(spark, target):
        # What is there is compared as (path, time), never with the contents.
        there = read_batches(spark, target).select("path", "modified")
        fresh = new.select("path", "modified").join(there, ["path", "modified"], "left_anti")
        with _settings(spark, sizes):
            new = new.join(materialize(fresh, "files"), ["path", "modified"], "left_semi").select(new.columns)
    with _settings(spark, sizes):
        return append_batch(new, target, batch)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_packed(spark: SparkSession, target: str) -> DataFrame:
    """(``path``, ``content``) of the packed files, of each path the last version, as :func:`scan_docs` gives them."""
    rows = read_batches(spark, target)
    last = rows.groupBy("path").agg(F.max("modified").alias("modified"))
    newest = rows.join(last, ["path", "modified"], "left_semi")
    content = _text(F.col("content").cast("string"))
    return newest.select(_plain_path(F.col("path")).alias("path"), content.alias("content"))


# Texts of the run report.
REPORT_TITLE = "  RELATÓRIO DE EXECUÇÃO - ORQUESTRADOR PAI"
REPORT_DATE = "  Data: "
REPORT_DURATION = "  Duração Total: "
REPORT_SECONDS = " segundos"
REPORT_HEADS = ("ORQUESTRADOR", "STATUS", "INÍCIO", "CONCLUSÃO", "MOTIVO FALHA")
REPORT_SUMMARY = "RESUMO:"
REPORT_TOTAL = "  - Total de orquestradores: "
REPORT_OK = "  - Sucessos: "
REPORT_FAILED = "  - Falhas: "
REPORT_RATE = "  - Taxa de sucesso: "


def report_lines(
    runs: DataFrame,
    order_by: str,
    total_duration: float,
    at: dt.datetime,
    status: str = "status",
    reason_width: int | None = None,
    title: str = REPORT_TITLE,
    wrap: bool = False,
    **columns: str,
) -> DataFrame:
    """The run report as rows ``(section, key, place, line)``; sorted by the first three they are its text.

    Section 0 is the head, 1 holds one line per run in the order of ``key``, which is the
    column ``order_by``, 2 the summary; the other two are ordered by ``place``.  ``columns`` name
    the other columns as in :func:`report_rows`.  A reason longer than its column runs past the frame; with
    ``wrap`` it goes on in further lines of the run, numbered by ``place``, and nothing leaves the frame.
    """
    key_type = runs.schema[order_by].dataType
    cells = report_rows(runs, status=status, keep=[order_by], reason_width=reason_width, **columns)
    fixed = F.concat_ws(" | ", "name", "status", "start", "end")
    room = REASON_WIDTH if reason_width is None else reason_width
    if wrap:
        # Lines of the reason; those after the first have empty cells before it.
        pieces = F.regexp_extract_all("reason", F.lit(f"(?s).{{1,{room}}}"), 0)
        blank = F.concat_ws(" | ", *[F.repeat(F.lit(" "), F.length(c)) for c in ("name", "status", "start", "end")])
        cells = cells.select(
            quoted(order_by), fixed.alias("fixed"), blank.alias("blank"), F.posexplode(pieces).alias("place", "piece")
        )
        cells = cells.select(
            quoted(order_by),
            F.when(F.col("place") == 0, F.col("fixed")).otherwise(F.col("blank")).alias("fixed"),
            F.col("place").cast("bigint").alias("place"),
            padded(F.regexp_replace("piece", r"\R", " "), room).alias("reason"),
        )
    else:
        cells = cells.select(quoted(order_by), fixed.alias("fixed"), F.lit(0).cast("bigint").alias("place"), "reason")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "fixed", "reason"), F.lit(" |"))
    body = cells.select(F.lit(1).alias("section"), quoted(order_by).alias("key"), "place", line.alias("line"))

    frame = with_params(run_summary(runs, status, duration=None), name_width(runs, columns.get("name", "orchestrator")))
    widths = [F.col("width"), *[F.lit(w) for w in (STATUS_WIDTH, DATE_WIDTH, DATE_WIDTH, room)]]
    rule = F.concat(F.lit("+"), F.concat_ws("+", *[F.repeat(F.lit("-"), w + 2) for w in widths]), F.lit("+"))
    edge = F.repeat(F.lit("="), F.length(rule))
    heads = F.concat_ws(" | ", *[padded(F.lit(h), w) for h, w in zip(REPORT_HEADS, widths)])
    count = lambda label, name: F.concat(F.lit(label), F.col(name).cast("string"))

    head = [
        edge,
        title,
        REPORT_DATE + at.strftime("%d/%m/%Y %H:%M:%S"),
        REPORT_DURATION + f"{total_duration:.2f}" + REPORT_SECONDS,
        edge,
        "",
        rule,
        F.concat(F.lit("| "), heads, F.lit(" |")),
        rule,
    ]
    summary = [
        rule,
        "",
        REPORT_SUMMARY,
        count(REPORT_TOTAL, "total"),
        count(REPORT_OK, "successes"),
        count(REPORT_FAILED, "failures"),
        F.concat(count(REPORT_RATE, "success_pct"), F.lit("%")),
        "",
        edge,
    ]
    rest = [
        F.struct(
            F.lit(number).alias("section"),
            F.lit(None).cast(key_type).alias("key"),
            F.lit(place).cast("bigint").alias("place"),
            (text if isinstance(text, Column) else F.lit(text)).alias("line"),
        )
        for number, lines in ((0, head), (2, summary))
        for place, text in enumerate(lines)
    ]
    return body.unionByName(frame.select(F.inline(F.array(*rest))))


def write_report(lines: DataFrame, path: str, fmt: str = "text") -> None:
    """Write report lines in order: the part files in name order are the report.

    The sort cuts the lines into ranges, so the whole report never meets in one task.
    ``fmt="csv"`` writes any table with a header line instead.
    """
    if fmt == "csv":
        lines.write.mode("overwrite").option("header", True).csv(path)
        return
    lines.orderBy("section", "key", "place").select("line").write.mode("overwrite").text(path)
