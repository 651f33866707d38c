import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from oracle import same

from sparkstave.llm import conversations as op
from sparkstave.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind int, cost string, place string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, "x", None) for r in rows], SCHEMA).repartition(parts)


def shape(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(rows):
    """All edits of rows (role, text, fault), tried one by one: (cost, audit, repaired rows) of the least."""
    best = {"": (0, "", ())}  # by initials so far; the contract's states are not used here
    reach = lambda found: {k: min(v) for k, v in found.items()}

    def inserted(now):
        found = {k: [v] for k, v in now.items()}
        for _ in range(2):
            for k, vs in list(found.items()):
                for c, a, out in list(vs):
                    for role in ("user", "assistant"):
                        found.setdefault(k + role[0], []).append((c + 2, a + "I", (*out, f"{role}:")))
            found = {k: [min(vs)] for k, vs in found.items() if re.fullmatch("s?(ua)*u?", k)}
        return {k: vs[0] for k, vs in found.items()}

    for role, text, fault in rows:
        found = {}
        for k, (c, a, out) in inserted(best).items():
            found.setdefault(k, []).append((c + 3, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            found.setdefault(k + (role[:1] or "?"), []).append((c + cut, a + "K", (*out, f"{role}:{text}")))
            for new in ("user", "assistant"):
                found.setdefault(k + new[0], []).append((c + 2 + cut, a + "R", (*out, f"{new}:{text}")))
        best = {k: v for k, v in reach(found).items() if re.fullmatch("s?(ua)*u?", k)}
    return min(v for k, v in inserted(best).items() if shape(k))


def plain(rows):
    """The contract, row by row."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        hurt = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hurt == 1:
            text = ""
        if hurt == 2:
            text = re.sub("[.!?]", "", text)
        if hurt == 4:
            role = "user"
        if hurt:
            mine += [(turn, role, text)] * (2 if hurt == 3 else 1)
    result = []
    for conv, mine in out.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            blank = not text.strip(SPACE)
            faults.append("blank" if blank else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACE)[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, repaired = cheapest([(r, t, f) for (_, r, t), f in zip(mine, faults, strict=True)])
        result.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(result, key=str)


def made(seed, n_convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser"])
            text = rng.choice(["Yes.", "No", "ok!", "", None, " \t\n", f"word {rng.random()}.", f"é {rng.random()}", "a.b? \r\n", "x" * rng.randint(1, 40) + "?"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(40))
def test_least_audit(seed):
    """Cost, audit and rows of the divided search equal those of all edits tried, for any kinds of rows."""
    rng = random.Random(seed)
    for _ in range(15):
        kinds = [rng.randrange(16) for _ in range(rng.randint(0, 9))]
        roles = [["system", "user", "assistant", "tool"][k % 4] for k in kinds]
        texts = [str(i) for i in range(len(kinds))]
        faults = ["blank", "duplicate", "truncated", ""]
        cost, audit, rows = op.repaired(kinds, roles, texts)
        assert (cost, audit, tuple(rows)) == cheapest([(r, t, faults[k // 4]) for k, r, t in zip(kinds, roles, texts, strict=True)])
        if len(kinds) > 2:  # the same through blocks
            cuts = sorted(rng.sample(range(len(kinds) + 1), 2))
            blocks = [kinds[: cuts[0]], kinds[cuts[0] : cuts[1]], kinds[cuts[1] :]]
            states = op.crossings([op.composed(b) for b in blocks], op.NOTHING, op.END_COSTS, op._forward, op._backward)
            pieces = [op.repaired(b, roles, texts, states[i], states[i + 1] if i < 2 else None) for i, b in enumerate(blocks)]
            assert "".join(p[1] for p in pieces) == audit and sum(p[0] for p in pieces) == cost


def test_equals_plain(spark):
    rows = made(1, 150, 12)
    rows += [(None, t, r, x) for _, t, r, x in made(2, 1, 9)]
    rows += rows[:20] + [(9000, None, None, None), (9001, -5, "user", "long. " * 50_000)]
    assert got(op.repaired_conversations(frame(spark, rows))) == plain(rows)


def test_conversation_over_many_blocks(spark, monkeypatch):
    """Small blocks and groups: several levels of composed steps."""
    for name, value in (("BLOCK_ROWS", 5), ("BLOCK_CHARS", 60), ("FAN", 2), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(op, name, value)
    rows = [(c if c % 3 else 1, t if c % 3 else c * 100 + t, r, x) for c, t, r, x in made(3, 60, 12) if t is not None]
    assert got(op.repaired_conversations(frame(spark, rows, 6))) == plain(rows)


def test_all_rows_dropped_and_empty(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(op.repaired_conversations(frame(spark, [(5, turn, "user", "Hi.")]))) == [(5, 0, 0, 0, 0, 0, 0, "", empty)]
    assert op.repaired_conversations(frame(spark, [])).count() == 0


def test_equals_sql(spark, small_dir, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in made(4, 40, 9)] + [(None, 3, "user", "Hm."), (None, None, None, None)]
    path = str(tmp_path / "conversations.parquet")
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    sql = queries.SQL["op11_hirschberg_repair"]
    same(queries.op11_hirschberg_repair(spark, str(tmp_path)), con, sql)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{small_dir}/conversations.parquet'")
    same(queries.op11_hirschberg_repair(spark, small_dir), con, sql)


def test_functions_travel_by_value(small_dir, tmp_path):
    """Executors have no copy of the package: the query runs where only the driver can import it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"import sys; sys.path.insert(0, {root!r})\nimport __spark_entry__ as e\nfrom sparkstave.session import default_session\nprint('rows', e.queries()['op11_hirschberg_repair'](default_session('t', '2', 2), {small_dir!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 20" in done.stdout, done.stderr[-2000:]
