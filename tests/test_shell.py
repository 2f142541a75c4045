"""Labels and file operations of shell commands."""

from pyspark.sql import functions as F

from stockline.functions import text as X


def test_labels(spark):
    want = {
        "git -C /a -c x=y commit -m 'a b'": ("git commit", ""), "git -C /a status": ("git status", ""), "cd /a && cd b && npm run build": ("npm run", "build"),
        "yarn --version": ("yarn", ""), "bash scripts/x.sh a": ("bash x.sh", "a"), "curl -s https://u:p@a.example:80/x": ("curl", "a.example"), "A=1 B=2 sudo env make all | tee log": ("make", "all"),
        "# one\n# two\npython run.py 'x && y' z": ("python", "run.py"), "export A=1; ls": ("ls", ""), "docker compose up": ("docker compose", "up"), "echo 'a; b' c": ("echo", "c"), "X=1": ("(bash)", ""), "cd /tmp": ("(bash)", ""),
    }
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "c string").select("c", X.shell_label("c").alias("x")).collect()
    assert {r.c: tuple(r.x) for r in rows} == {**want, None: ("(bash)", "")}


def test_file_operations(spark):
    want = {
        "cat 'a b.txt'": ("cat", "a b.txt", None), "cd /a && cd b && head -20 x.md": ("head", "x.md", "b"), "cat a.txt > b.txt": ("cat", "a.txt", None), "cat ~/x": None, "cat *.js": None, "rg -n foo src/": ("grep-n", "src/", None),
        "grep -rn 'a b' ./x.py 2>/dev/null": ("grep-n", "./x.py", None), "grep -n foo .": None, "cat <<EOF >o.txt\nx\nEOF": ("cat-write", "o.txt", None), "cat <<'E' >> o.txt\nx\nE": ("cat-write", "o.txt", None), "cat": None, "cat `x`": None, "sudo cat /etc/hosts": ("cat", "/etc/hosts", None),
    }
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "c string").select("c", X.shell_file_op("c").alias("x")).collect()
    assert {r.c: tuple(r.x) if r.x else None for r in rows} == {**want, None: None}


def test_flags_and_ids(spark):
    from stockline.functions import economics as E
    from stockline.functions.models import tier_flag

    rows = spark.createDataFrame([("s-1", True), ("../x", False), ("", None)], "s string, sub boolean")
    assert [r.ok for r in rows.select(X.valid_session_id("s").alias("ok")).collect()] == [True, False, False]
    assert [r.f for r in rows.select(tier_flag(F.col("sub")).alias("f")).collect()] == ["sub", "agent", "agent"]
    one = spark.range(1).select(E.gate_regret(2.0, 1.5, 0.3), E.gate_regret(1.2, 1.5, 0.3), E.delta_residual(30, 100)["overshoot"], E.delta_residual(100, 30)["residual"]).first()
    assert tuple(one) == (0.3, None, 70.0, 70.0)
