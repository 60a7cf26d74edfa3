"""Queries over script runs; events stand for runs, an error event for a failed one."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import runs as R
from ..session import new_path
from ..sources.files import read_log_lines, read_run_results, report_lines, write_documents, write_report
from .registry import query


def event_runs(t):
    """One run per event: the user is the orchestrator, the day the script."""
    return t.events.select(
        F.col("user_id").alias("orchestrator"),
        F.date_format("ts", "yyyy-MM-dd").alias("script"),
        "event_id",
        F.when(F.col("event_type") == "error", "falha").otherwise("sucesso").alias("status"),
        F.col("value").alias("duration_s"),
        F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 100)).alias("end"),
    )


EVENT_RUNS = (
    "(SELECT user_id AS orchestrator, strftime(ts, '%Y-%m-%d') AS script, event_id,"
    " CASE WHEN event_type = 'error' THEN 'falha' ELSE 'sucesso' END AS status, value AS duration_s,"
    ' ts AS "start", ts + to_seconds(event_id % 100) AS "end" FROM events) AS r'
)


@query(
    "run_classify",
    "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'erro_json' WHEN user_id % 7 = 1 THEN 'timeout'"
    " WHEN user_id % 7 = 2 THEN 'nao_encontrado' WHEN user_id % 7 = 3 THEN 'erro_permissao'"
    " WHEN value > 50 THEN 'timeout' WHEN event_type = 'error' THEN 'falha' ELSE 'sucesso' END AS status FROM events",
)
def _(t):
    kind = F.col("user_id") % 7
    df = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("code"),
        "value",
        F.when(kind == 0, "{").alias("corrupt"),
        F.when(kind == 1, "TimeoutError").when(kind == 2, "FileNotFoundError").when(kind == 3, "PermissionError").alias("err"),
    )
    return R.classify_status(df, "code", "err", "value", 50.0, "corrupt").select("event_id", "status")


@query(
    "run_overall_status",
    "SELECT c_custkey AS orchestrator, CAST(count(r.status) AS BIGINT) AS total,"
    " CAST(count(*) FILTER (WHERE r.status = 'sucesso') AS BIGINT) AS successes,"
    " CASE WHEN count(r.status) = 0 THEN 'nao_executado' WHEN count(*) FILTER (WHERE r.status = 'falha') = 0 THEN 'sucesso_total'"
    " WHEN count(*) FILTER (WHERE r.status = 'sucesso') = 0 THEN 'falha_total' ELSE 'sucesso_parcial' END AS overall"
    f" FROM customer LEFT JOIN {EVENT_RUNS} ON c_custkey = r.orchestrator GROUP BY c_custkey",
)
def _(t):
    return R.overall_status(event_runs(t), "orchestrator", expected=t.customer.selectExpr("c_custkey AS orchestrator"))


@query(
    "run_retry_resolve",
    "SELECT task, attempt, status FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY status = 'sucesso' DESC,"
    " CASE WHEN status = 'sucesso' THEN attempt ELSE -attempt END) AS rn FROM (SELECT event_id // 5 AS task, event_id % 5 + 1 AS attempt,"
    " CASE WHEN event_type IN ('error', 'click', 'view') THEN 'falha' ELSE 'sucesso' END AS status FROM events)"
    " WHERE attempt <= 3) WHERE rn = 1",
)
def _(t):
    df = t.events.select(
        F.expr("event_id div 5").alias("task"),
        (F.col("event_id") % 5 + 1).alias("attempt"),
        F.when(F.col("event_type").isin("error", "click", "view"), "falha").otherwise("sucesso").alias("status"),
    )
    return R.resolve_attempts(df, "task", max_attempts=3)


@query(
    "run_stop_on_error",
    "SELECT orchestrator, script, event_id, status FROM (SELECT *, coalesce(sum(CASE WHEN status = 'falha' THEN 1 ELSE 0 END)"
    ' OVER (PARTITION BY orchestrator ORDER BY "start", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before'
    f" FROM {EVENT_RUNS}) WHERE before = 0",
)
def _(t):
    df = R.stop_at_first_failure(event_runs(t), "orchestrator", ["start", "event_id"])
    return df.select("orchestrator", "script", "event_id", "status")


@query(
    "run_summary",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'sucesso') AS BIGINT) AS successes,"
    " CAST(count(*) FILTER (WHERE status <> 'sucesso') AS BIGINT) AS failures,"
    " round_even(100.0 * count(*) FILTER (WHERE status = 'sucesso') / count(*), 1) AS success_pct,"
    f" round(sum(duration_s), 2) AS total_duration FROM {EVENT_RUNS}",
)
def _(t):
    return R.run_summary(event_runs(t)).withColumn("total_duration", F.round("total_duration", 2))


@query(
    "run_exit_code",
    "SELECT script, total, successes, CASE WHEN successes = total THEN 'sucesso_total' WHEN successes = 0 THEN 'falha_total'"
    " ELSE 'sucesso_parcial' END AS overall, CAST(CASE WHEN successes = total THEN 0 WHEN successes = 0 THEN 2 ELSE 1 END AS BIGINT) AS parent_code,"
    " CAST(CASE WHEN successes = total THEN 0 ELSE 1 END AS BIGINT) AS child_code FROM (SELECT orchestrator || '/' || script AS script,"
    " CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'sucesso') AS BIGINT) AS successes"
    f" FROM {EVENT_RUNS} GROUP BY ALL)",
)
def _(t):
    df = event_runs(t).withColumn("script", F.concat_ws("/", F.col("orchestrator").cast("string"), "script"))
    return R.exit_code(df, "script")


@query(
    "run_report",
    'SELECT event_id, rpad(CAST(orchestrator AS VARCHAR), 20, \' \') AS name, rpad(upper(status), 15, \' \') AS status,'
    " strftime(\"start\", '%d/%m/%Y %H:%M:%S') AS \"start\", strftime(\"end\", '%d/%m/%Y %H:%M:%S') AS \"end\","
    " rpad(substr(CASE WHEN status = 'falha' THEN repeat('erro ' || script || ' ', 5) ELSE '' END, 1, 50), 50, ' ') AS reason"
    f" FROM {EVENT_RUNS}",
)
def _(t):
    df = event_runs(t).withColumn(
        "err_msg", F.when(F.col("status") == "falha", F.repeat(F.concat(F.lit("erro "), "script", F.lit(" ")), F.lit(5)))
    )
    return R.report_rows(df, keep=["event_id"], reason_width=50)


# The whole report: head, a line per event, summary.  n and m are the widths of name and reason.
REPORT_SQL = (
    "WITH w AS (SELECT greatest(20, max(length(CAST(user_id AS VARCHAR))))::INT AS n, greatest(50, max(length(props || ' ' || event_type)))::INT AS m,"
    " count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events),"
    " f AS (SELECT *, '+' || repeat('-', n + 2) || '+' || repeat('-', 17) || '+' || repeat('-', 21) || '+' || repeat('-', 21)"
    " || '+' || repeat('-', m + 2) || '+' AS rule FROM w),"
    " h AS (SELECT *, repeat('=', length(rule)) AS edge, '| ' || rpad('ORQUESTRADOR', n, ' ') || ' | ' || rpad('STATUS', 15, ' ') || ' | '"
    " || rpad('INÍCIO', 19, ' ') || ' | ' || rpad('CONCLUSÃO', 19, ' ') || ' | ' || rpad('MOTIVO FALHA', m, ' ') || ' |' AS heads FROM f),"
    " e AS (SELECT 0 AS section, [edge, '  RELATÓRIO DE EXECUÇÃO', '  Data: 31/01/2024 00:00:00', '  Duração Total: 12.50 segundos',"
    " edge, '', rule, heads, rule] AS lines FROM h UNION ALL SELECT 2, [rule, '', 'RESUMO:', '  - Total de orquestradores: ' || total,"
    " '  - Sucessos: ' || ok, '  - Falhas: ' || (total - ok), '  - Taxa de sucesso: ' || round_even(100.0 * ok / total, 1) || '%', '', edge] FROM h),"
    " report AS (SELECT section, NULL::VARCHAR AS key, unnest(range(9)) AS place, unnest(lines) AS line FROM e UNION ALL"
    " SELECT 1, strftime(ts, '%Y-%m-%d') || ' ' || event_id, 0, '| ' || concat_ws(' | ', rpad(CAST(orchestrator AS VARCHAR), n, ' '),"
    " rpad(upper(status), 15, ' '), strftime(\"start\", '%d/%m/%Y %H:%M:%S'), strftime(\"end\", '%d/%m/%Y %H:%M:%S'),"
    " rpad(props || ' ' || event_type, m, ' ')) || ' |'"
    f" FROM {EVENT_RUNS} JOIN events USING (event_id) CROSS JOIN w)"
)


def event_report(t):
    reasons = t.events.select("event_id", F.concat_ws(" ", "props", "event_type").alias("err_msg"))
    df = event_runs(t).join(reasons, "event_id").withColumn("key", F.concat_ws(" ", "script", F.col("event_id").cast("string")))
    return report_lines(df, "key", 12.5, dt.datetime(2024, 1, 31), title="  RELATÓRIO DE EXECUÇÃO")


@query("run_report_lines", f"{REPORT_SQL} SELECT section, key, place, line FROM report")
def _(t):
    return event_report(t)


@query("write_report", f"{REPORT_SQL} SELECT line FROM report")
def _(t):
    """Written in order, then read as text."""
    path = new_path(t.spark, "report")
    write_report(event_report(t), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "run_duration",
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 300.0 ELSE CAST(event_id % 100 AS DOUBLE) END AS duration_s FROM events",
)
def _(t):
    df = event_runs(t).withColumn("status", F.when(F.col("event_id") % 10 == 0, "timeout").otherwise(F.col("status")))
    return R.durations(df, status="status", timeout=300).select("event_id", "duration_s")


@query(
    "run_flatten",
    "SELECT CAST(o_custkey AS VARCHAR) AS nome_orquestrador, CAST(1 AS BIGINT) AS ordinal, o_orderpriority AS nome_script, 'sucesso' AS status, o_totalprice AS duracao_segundos FROM orders"
    " UNION ALL SELECT CAST(o_custkey AS VARCHAR), 2, 'script-' || o_orderkey, 'falha', 0.0 FROM orders",
)
def _(t):
    script = lambda name, status, seconds: F.struct(
        name.alias("nome_script"), F.lit(status).alias("status"), seconds.alias("duracao_segundos")
    )
    results = t.orders.select(
        F.col("o_custkey").cast("string").alias("nome_orquestrador"),
        F.array(
            script(F.col("o_orderpriority"), "sucesso", F.col("o_totalprice")),
            script(F.concat(F.lit("script-"), F.col("o_orderkey").cast("string")), "falha", F.lit(0.0)),
        ).alias("resultados_scripts"),
    )
    return R.flatten_runs(results)


@query(
    "read_run_results",
    "SELECT block % 25 AS part, 'sucesso_total' AS status, CAST(block AS VARCHAR) AS name, c_name AS script, c_custkey AS attempts"
    " FROM (SELECT *, c_custkey // 50 AS block FROM customer) WHERE block % 50 <> 7"
    " UNION ALL SELECT block % 25, 'erro_json', NULL, NULL, NULL FROM (SELECT DISTINCT c_custkey // 50 AS block FROM customer) WHERE block % 50 = 7",
)
def _(t):
    """A result document for each 50 customers, who are its scripts; a fiftieth of the documents is broken off."""
    script = F.struct(F.col("c_name").alias("nome_script"), F.col("c_custkey").alias("tentativas"))
    blocks = t.customer.groupBy(F.expr("c_custkey div 50").alias("block")).agg(F.array_sort(F.collect_list(script)).alias("resultados_scripts"))
    document = F.to_json(
        F.struct(F.col("block").cast("string").alias("nome_orquestrador"), F.lit("sucesso_total").alias("status_geral"), "resultados_scripts")
    )
    text = F.when(F.col("block") % 50 == 7, F.substring(document, 1, 40)).otherwise(document)
    path = new_path(t.spark, "results")
    write_documents(blocks.select(F.expr("block % 25").alias("part"), text.alias("value")), path, "part")
    read = read_run_results(t.spark, path).select(
        F.col("part").cast("bigint").alias("part"), "status", "nome_orquestrador", F.explode_outer("resultados_scripts").alias("r")
    )
    return read.select(
        "part", "status", F.col("nome_orquestrador").alias("name"), F.col("r.nome_script").alias("script"), F.col("r.tentativas").alias("attempts")
    )


@query("log_parse", "SELECT date_trunc('second', ts) AS ts, upper(event_type) AS level, props || ' | ' || user_id AS message FROM events")
def _(t):
    """Written as text lines first, then read as a log."""
    lines = t.events.select(
        F.concat_ws(
            " | ",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.rpad(F.upper("event_type"), 8, " "),
            F.concat_ws(" | ", "props", F.col("user_id").cast("string")),
        ).alias("value")
    )
    path = new_path(t.spark, "log")
    lines.write.text(path)
    return R.parse_log_lines(read_log_lines(t.spark, path))


@query(
    "normalise_tasks",
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type END AS path,"
    " CASE WHEN p_size % 3 <> 0 AND p_size % 2 = 0 THEN p_brand ELSE '' END AS args, p_size % 3 < 2 AS accepted FROM part",
)
def _(t):
    """A text names a path, else a path with arguments, else the task is rejected."""
    kind = F.col("p_size") % 3
    df = t.part.select(
        "p_partkey",
        F.when(kind == 0, F.col("p_name")).alias("text"),
        F.when(kind == 1, F.col("p_type")).alias("path"),
        F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).alias("args"),
    )
    out = R.normalise_tasks(df, keep=["p_partkey"])
    return out.withColumn("args", F.array_join("args", " "))
