"""Analytics over tables of script runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import br_datetime, micros_between, parse_timestamp
from ..functions.text import strip, truncate_text
from ..missing import as_list, check_columns, quoted, same_keys

# States of one run and of a set of runs, and their report labels.
SUCCESS = "sucesso"
FAILURE = "falha"
TIMEOUT = "timeout"
NOT_FOUND = "nao_encontrado"
NO_PERMISSION = "erro_permissao"
BAD_JSON = "erro_json"

ALL_OK = "sucesso_total"
SOME_OK = "sucesso_parcial"
NONE_OK = "falha_total"
NOT_RUN = "nao_executado"

STATUS_LABELS = {
    "sucesso": "SUCESSO",
    "falha": "FALHA",
    "timeout": "TIMEOUT",
    "nao_encontrado": "NÃO ENCONTRADO",
    "erro_json": "ERRO JSON",
}

NAME_WIDTH = 20
STATUS_WIDTH = 15
DATE_WIDTH = 19
REASON_WIDTH = 50


def flatten_runs(results: DataFrame) -> DataFrame:
    """One row per script of each run result, numbered from 1 in list order."""
    return results.select(
        F.col("nome_orquestrador"), F.posexplode("resultados_scripts").alias("pos", "r")
    ).select("nome_orquestrador", (F.col("pos") + 1).cast("bigint").alias("ordinal"), "r.*")


def classify_status(
    df: DataFrame,
    exit_code: str = "exit_code",
    err_type: str | None = None,
    duration: str | None = None,
    timeout: float | None = None,
    corrupt: str | None = None,
    out: str = "status",
) -> DataFrame:
    """State of a run: unreadable result, time limit, error type, then the exit code."""
    code = quoted(exit_code)
    chain = F
    if corrupt:
        chain = chain.when(quoted(corrupt).isNotNull(), BAD_JSON)
    if err_type:
        kind = quoted(err_type)
        chain = chain.when(kind == "TimeoutError", TIMEOUT)
        chain = chain.when(kind == "FileNotFoundError", NOT_FOUND)
        chain = chain.when(kind == "PermissionError", NO_PERMISSION)
    if duration and timeout is not None:
        chain = chain.when(quoted(duration) > F.lit(timeout), TIMEOUT)
    return df.withColumn(out, chain.when(code == 0, SUCCESS).otherwise(FAILURE))


def _overall(total: Column, ok: Column) -> Column:
    return (
        F.when(total == 0, NOT_RUN)
        .when(ok == total, ALL_OK)
        .when(ok == 0, NONE_OK)
        .otherwise(SOME_OK)
    )


def overall_status(
    runs: DataFrame, keys: Sequence[str] | str = (), status: str = "status", expected: DataFrame | None = None
) -> DataFrame:
    """Overall state per key (or of all runs): ``total``, ``successes``, ``overall``.

    Keys of ``expected`` without any run are reported as not run.
    """
    keys = as_list(keys)
    counts = runs.groupBy(*[quoted(k) for k in keys]).agg(
        F.count("*").alias("total"), F.count_if(quoted(status) == SUCCESS).alias("successes")
    )
    if expected is not None:
        right = counts.toDF(*[f"__k{i}" for i in range(len(keys))], "total", "successes")
        left = expected.select(*[quoted(k) for k in keys]).distinct()
        counts = left.join(right, same_keys([(k, f"__k{i}") for i, k in enumerate(keys)]), "left")
    return counts.select(
        *[quoted(k) for k in keys],
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("successes", F.lit(0)).alias("successes"),
    ).withColumn("overall", _overall(F.col("total"), F.col("successes")))


def resolve_attempts(
    runs: DataFrame,
    keys: Sequence[str] | str,
    attempt: str = "attempt",
    status: str = "status",
    max_attempts: int | None = None,
) -> DataFrame:
    """The attempt that counts: the first success, else the last one; with ``max_attempts`` later
    attempts do not count.

    The choice is an aggregate with one row of state per key, not a window over the key.
    """
    keys = as_list(keys)
    check_columns(runs, [*keys, attempt, status])
    ok = quoted(status) == SUCCESS
    # Successes come first in attempt order, failures after them in reverse order.
    place = F.struct(
        F.coalesce(~ok, F.lit(True)), F.when(ok, quoted(attempt)).otherwise(-quoted(attempt))
    )
    rest = [c for c in runs.columns if c not in keys]
    chosen = F.min_by(F.struct(*[quoted(c) for c in rest]), place).alias("__run")
    return (
        (runs if max_attempts is None else runs.where(quoted(attempt) <= max_attempts))
        .groupBy(*[quoted(k) for k in keys])
        .agg(chosen)
        .select(*[quoted(c) if c in keys else F.col("__run")[c].alias(c) for c in runs.columns])
    )


def stop_at_first_failure(
    runs: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, status: str = "status"
) -> DataFrame:
    """Runs up to and including the first failure of each key.

    The first failing place per key is an aggregate; the runs stay where they are split.
    """
    keys, order = as_list(keys), as_list(order)
    check_columns(runs, [*keys, *order, status])
    place = F.struct(*[quoted(o).alias(f"o{i}") for i, o in enumerate(order)])
    failed = ~quoted(status).eqNullSafe(SUCCESS)
    limits = runs.where(failed).groupBy(
        *[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    ).agg(F.min(place).alias("__limit"))
    if not keys:
        limit = limits.scalar()
        return runs.where(limit.isNull() | (place <= limit))
    joined = runs.join(limits, same_keys([(k, f"__k{i}") for i, k in enumerate(keys)]), "left")
    return joined.where(F.col("__limit").isNull() | (place <= F.col("__limit"))).select(
        *[quoted(c) for c in runs.columns]
    )


def run_summary(runs: DataFrame, status: str = "status", duration: str | None = "duration_s") -> DataFrame:
    """One row: ``total``, ``successes``, ``failures``, ``success_pct`` (one decimal), ``total_duration``."""
    total, ok = F.count("*"), F.count_if(quoted(status) == SUCCESS)
    seconds = [F.coalesce(F.sum(quoted(duration)), F.lit(0.0)).alias("total_duration")] if duration else []
    sums = runs.agg(total.alias("total"), ok.alias("successes"), *seconds)
    pct = F.when(F.col("total") > 0, F.col("successes") * 100.0 / F.col("total")).otherwise(0.0)
    return sums.select(
        "total",
        "successes",
        (F.col("total") - F.col("successes")).alias("failures"),
        F.bround(pct, 1).alias("success_pct"),
        *(["total_duration"] if duration else []),
    )


def parent_exit_code(total: Column, successes: Column) -> Column:
    """0 if all runs succeeded, 2 if none did, else 1."""
    return F.when(successes == total, 0).when(successes == 0, 2).otherwise(1)


def child_exit_code(overall: Column) -> Column:
    """0 for total success, 2 if nothing ran, else 1."""
    return F.when(overall == ALL_OK, 0).when(overall == NOT_RUN, 2).otherwise(1)


def exit_code(runs: DataFrame, keys: Sequence[str] | str = (), status: str = "status") -> DataFrame:
    """Overall state plus the exit codes of a parent and of a child runner."""
    return overall_status(runs, keys, status).withColumns(
        {
            "parent_code": parent_exit_code(F.col("total"), F.col("successes")).cast("bigint"),
            "child_code": child_exit_code(F.col("overall")).cast("bigint"),
        }
    )


def padded(col: Column, width: int | Column) -> Column:
    """Fill up with blanks to ``width``; longer text is not cut."""
    text = F.coalesce(col, F.lit(""))
    width = width if isinstance(width, Column) else F.lit(width)
    return F.rpad(text, F.greatest(width, F.length(text)), F.lit(" "))


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(t) for pair in STATUS_LABELS.items() for t in pair])
    return F.coalesce(F.try_element_at(labels, status), F.upper(status))


def report_rows(
    runs: DataFrame,
    name: str = "orchestrator",
    status: str = "status",
    start: str = "start",
    end: str = "end",
    reason: str = "err_msg",
    keep: Sequence[str] = (),
    reason_width: int | None = None,
) -> DataFrame:
    """The cells of a report line, padded: ``name``, ``status``, ``start``, ``end``, ``reason``.

    The name column is as wide as the longest name, at least 20.  ``keep`` names
    columns that stay in front.  The reason, being the last cell, is cut to ``reason_width`` if that is
    given, else whole: one longer than :data:`REASON_WIDTH` runs past the frame and widens no other row.
    """
    width = name_width(runs, name).scalar()
    text = lambda c: quoted(c).cast("string")
    cause = text(reason) if reason_width is None else truncate_text(quoted(reason), reason_width)
    return runs.select(
        *[quoted(c) for c in keep],
        padded(text(name), width).alias("name"),
        padded(status_label(quoted(status)), STATUS_WIDTH).alias("status"),
        padded(br_datetime(text(start)), DATE_WIDTH).alias("start"),
        padded(br_datetime(text(end)), DATE_WIDTH).alias("end"),
        padded(cause, REASON_WIDTH if reason_width is None else reason_width).alias("reason"),
    )


def name_width(runs: DataFrame, name: str) -> DataFrame:
    """One row: the width of the name column of a report."""
    longest = F.max(F.length(quoted(name).cast("string")))
    return runs.agg(F.greatest(F.lit(NAME_WIDTH), F.coalesce(longest, F.lit(0))).alias("width"))


def durations(
    df: DataFrame, start: str = "start", end: str = "end", status: str | None = None,
    timeout: float | None = None, out: str = "duration_s",
) -> DataFrame:
    """Seconds from start to end with fraction; a run stopped by the limit takes the limit."""
    seconds = micros_between(quoted(start), quoted(end)) / F.lit(1_000_000)
    if status and timeout is not None:
        seconds = F.when(quoted(status) == TIMEOUT, F.lit(float(timeout))).otherwise(seconds)
    return df.withColumn(out, seconds)


def parse_log_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Split ``time | LEVEL | message`` lines into ``ts``, ``level`` and ``message``."""
    parts = F.split(quoted(col), r" \| ", 3)
    return df.select(
        parse_timestamp(F.get(parts, F.lit(0)), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        strip(F.get(parts, F.lit(1))).alias("level"),
        F.get(parts, F.lit(2)).alias("message"),
    )


def normalise_tasks(
    df: DataFrame, text: str = "text", path: str = "path", args: str = "args", keep: Sequence[str] = ()
) -> DataFrame:
    """Task definitions as (``path``, ``args``): a plain text is a path without arguments.

    ``accepted`` is false where neither form names a path.  ``keep`` names columns that
    stay in front.
    """
    check_columns(df, [text, path, args])
    no_args = F.array().cast(df.schema[args].dataType)
    chosen = F.coalesce(quoted(text), quoted(path))
    return df.select(
        *[quoted(c) for c in keep],
        chosen.alias("path"),
        F.when(quoted(text).isNotNull(), no_args).otherwise(F.coalesce(quoted(args), no_args)).alias("args"),
        chosen.isNotNull().alias("accepted"),
    )
