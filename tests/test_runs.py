import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablewright import parse_run_results, read_log_lines, read_run_results, report_lines, runs as R, scan_docs, write_report

OK, BAD = "sucesso", "falha"


def script(name, status, attempt=1):
    return {
        "nome_script": name, "status": status, "inicio": "2026-02-09T06:00:00", "fim": "2026-02-09T06:00:02.500000",
        "duracao_segundos": 2.5, "codigo_saida": 0 if status == OK else 1, "saida_padrao": "", "saida_erro": "",
        "erro_tipo": None, "erro_mensagem": None, "erro_traceback": None, "tentativas": attempt,
    }


def result(name, overall, scripts):
    good = sum(s["status"] == OK for s in scripts)
    return {
        "nome_orquestrador": name, "status_geral": overall, "inicio_execucao": "2026-02-09T06:00:00",
        "fim_execucao": "2026-02-09T06:01:00", "duracao_total_segundos": 60.0, "total_scripts": len(scripts),
        "scripts_sucesso": good, "scripts_falha": len(scripts) - good, "resultados_scripts": scripts, "caminho_log": "x.log",
    }


@pytest.fixture
def results(spark, tmp_path):
    docs = {
        "a": result("a", "sucesso_total", [script("s1", OK), script("s2", OK)]),
        "b": result("b", "sucesso_parcial", [script("s1", BAD, 3), script("s2", OK)]),
        "c": result("c", "falha_total", [script("s1", BAD)]),
        "d": result("d", "nao_executado", []),
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "e.json").write_text('{"nome_orquestrador": "e", ')
    return read_run_results(spark, str(tmp_path))


def test_parse_like_read(spark, results, tmp_path):
    parsed = parse_run_results(scan_docs(spark, str(tmp_path), "*.json"))
    assert parsed.columns == results.columns
    name = lambda path: path.rsplit("/", 1)[1]
    plain = lambda df: sorted((name(r["path"]), r["status"], str(r["resultados_scripts"]), r["corrupt"] is None) for r in df.collect())
    assert plain(parsed) == plain(results)


def test_read_and_flatten(results):
    states = {r["path"].rsplit("/", 1)[1]: r["status"] for r in results.collect()}
    assert states == {
        "a.json": "sucesso_total", "b.json": "sucesso_parcial", "c.json": "falha_total",
        "d.json": "nao_executado", "e.json": "erro_json",
    }
    flat = R.flatten_runs(results)
    assert sorted((r["nome_orquestrador"], r["ordinal"], r["nome_script"], r["tentativas"]) for r in flat.collect()) == [
        ("a", 1, "s1", 1), ("a", 2, "s2", 1), ("b", 1, "s1", 3), ("b", 2, "s2", 1), ("c", 1, "s1", 1),
    ]
    expected = results.where("corrupt IS NULL").select("nome_orquestrador")
    overall = R.overall_status(flat, "nome_orquestrador", expected=expected)
    assert {r["nome_orquestrador"]: r["overall"] for r in overall.collect()} == {
        "a": "sucesso_total", "b": "sucesso_parcial", "c": "falha_total", "d": "nao_executado",
    }


def test_classify(spark):
    rows = [(0, None, 1.0), (1, None, 1.0), (None, "TimeoutError", 300.0), (None, "FileNotFoundError", 0.0),
            (None, "PermissionError", 0.0), (None, "KeyError", 0.0), (0, None, 301.0)]
    df = spark.createDataFrame(rows, "exit_code int, err string, s double")
    got = [r["status"] for r in R.classify_status(df, err_type="err", duration="s", timeout=300.0).collect()]
    assert got == [OK, BAD, "timeout", "nao_encontrado", "erro_permissao", BAD, "timeout"]


def attempts(spark):
    rows = [("a", 1, BAD), ("a", 2, OK), ("a", 3, OK), ("b", 1, BAD), ("b", 2, "timeout"), ("b", 3, BAD), ("b", 4, OK), ("c", 1, OK)]
    return spark.createDataFrame(rows, "script string, attempt int, status string")


def test_attempts(spark):
    got = sorted(tuple(r) for r in R.resolve_attempts(attempts(spark), "script", max_attempts=3).collect())
    assert got == [("a", 2, OK), ("b", 3, BAD), ("c", 1, OK)]
    got = sorted(tuple(r) for r in R.resolve_attempts(attempts(spark), "script").collect())
    assert got == [("a", 2, OK), ("b", 4, OK), ("c", 1, OK)]


def test_stop(spark):
    df = attempts(spark)
    got = sorted((r["script"], r["attempt"]) for r in R.stop_at_first_failure(df, "script", "attempt").collect())
    assert got == [("a", 1), ("b", 1), ("c", 1)]
    assert R.stop_at_first_failure(df, [], ["script", "attempt"]).count() == 1
    assert R.stop_at_first_failure(df.where("status = 'sucesso'"), [], "attempt").count() == 4


def test_summary_and_codes(spark):
    df = attempts(spark).withColumn("duration_s", F.lit(1.5))
    assert R.run_summary(df).first().asDict() == {
        "total": 8, "successes": 4, "failures": 4, "success_pct": 50.0, "total_duration": 12.0,
    }
    empty = R.run_summary(df.where("attempt > 9")).first()
    assert (empty["total"], empty["success_pct"], empty["total_duration"]) == (0, 0.0, 0.0)
    codes = {r["script"]: (r["parent_code"], r["child_code"]) for r in R.exit_code(df, "script").collect()}
    assert codes == {"a": (1, 1), "b": (1, 1), "c": (0, 0)}
    whole = R.exit_code(df.where("attempt > 9")).first()
    assert (whole["overall"], whole["parent_code"], whole["child_code"]) == ("nao_executado", 0, 2)
    only_bad = R.exit_code(df.where("script = 'b' AND attempt < 4"), "script").first()
    assert (only_bad["overall"], only_bad["parent_code"], only_bad["child_code"]) == ("falha_total", 2, 1)


def report_runs(spark):
    rows = [
        (2, "vendas", "falha", "2026-02-09T06:00:00", "2026-02-09T06:00:20", "x" * 60),
        (1, "um_orquestrador_de_nome_longo", "sucesso", "2026-02-09T06:00:00", "agora", None),
        (3, "estoque", "nao_encontrado", "2026-02-09T06:00:00", "2026-02-09T06:00:20", "sem arquivo"),
        (4, "outro", "erro_permissao", "2026-02-09T06:00:00", "2026-02-09T06:00:20", ""),
    ]
    return spark.createDataFrame(rows, "i int, orchestrator string, status string, start string, end string, err_msg string")


def test_report(spark, tmp_path):
    df = report_runs(spark)
    cells = {r["name"].strip(): r for r in R.report_rows(df, reason_width=50).collect()}
    assert {len(r["name"]) for r in cells.values()} == {29}
    assert cells["vendas"]["reason"] == "x" * 50
    assert cells["vendas"]["start"] == "09/02/2026 06:00:00"
    assert cells["um_orquestrador_de_nome_longo"]["end"] == "agora".ljust(19)
    assert cells["estoque"]["status"] == "NÃO ENCONTRADO".ljust(15)
    assert cells["outro"]["status"] == "ERRO_PERMISSAO".ljust(15)

    lines = report_lines(df, "i", 45.674, dt.datetime(2026, 2, 9, 7, 0), reason_width=50)
    write_report(lines, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    out = "".join(p.read_text() for p in parts).split("\n")
    width = 29 + 15 + 19 + 19 + 50 + 5 * 3 + 1
    assert out[0] == "=" * width and len(out[6]) == width
    assert out[2:4] == ["  Data: 09/02/2026 07:00:00", "  Duração Total: 45.67 segundos"]
    assert out[7].startswith("| ORQUESTRADOR                  | STATUS          | INÍCIO")
    assert out[9].startswith("| um_orquestrador_de_nome_longo | SUCESSO         | 09/02/2026 06:00:00 | agora ")
    assert out[10].startswith("| vendas ") and len(out[10]) == width
    assert "  - Taxa de sucesso: 25.0%" in out and "  - Falhas: 3" in out
    write_report(R.report_rows(df), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_one_long_reason_widens_no_other_line(spark):
    long = "linha um\n" + "y" * 1_000_000
    df = report_runs(spark).withColumn("err_msg", F.when(F.col("i") == 2, F.lit(long)).otherwise(F.col("err_msg")))
    at = dt.datetime(2026, 2, 9, 7, 0)
    width = 29 + 15 + 19 + 19 + 50 + 5 * 3 + 1
    lines = [r["line"] for r in report_lines(df, "i", 1.0, at).orderBy("section", "key", "place").collect()]
    assert [n for n, line in enumerate(lines) if len(line) > width] == [10]
    assert len(lines[10]) == width - 50 + len(long) and lines[10].endswith("y |")

    wrapped = [r["line"] for r in report_lines(df, "i", 1.0, at, wrap=True).orderBy("section", "key", "place").collect()]
    assert {len(line) for line in wrapped if line.startswith("|")} == {width}
    assert wrapped[:10] == lines[:10] and wrapped[-11:] == lines[-11:]
    own = wrapped[10:-11]
    cells = [line.rsplit(" | ", 1) for line in own[: -(-len(long) // 50)]]
    assert "".join(reason[:50] for _, reason in cells).rstrip() == long.replace("\n", " ")
    assert {rest.replace("|", "").strip() for rest, _ in cells[1:]} == {""}


def test_durations(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 0, 2, 500000), OK), (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2), "timeout")],
        "start timestamp_ntz, end timestamp_ntz, status string",
    )
    assert [r["duration_s"] for r in R.durations(df, status="status", timeout=300).collect()] == [2.5, 300.0]


def test_log(spark, tmp_path):
    (tmp_path / "x.log").write_text("2026-02-09 06:00:01 | INFO     | a | b\nbroken\n2026-02-09 06:00:02 | ERROR    | c\n")
    got = [tuple(r) for r in R.parse_log_lines(read_log_lines(spark, str(tmp_path / "x.log"))).collect()]
    assert got == [
        (dt.datetime(2026, 2, 9, 6, 0, 1), "INFO", "a | b"), (None, None, None), (dt.datetime(2026, 2, 9, 6, 0, 2), "ERROR", "c"),
    ]


def test_tasks(spark):
    df = spark.createDataFrame(
        [("a.py", None, None), (None, "b.py", ["--v"]), (None, "c.py", None), (None, None, ["x"])],
        "text string, path string, args array<string>",
    )
    got = [tuple(r) for r in R.normalise_tasks(df).collect()]
    assert got == [("a.py", [], True), ("b.py", ["--v"], True), ("c.py", [], True), (None, ["x"], False)]
