import hashlib
import itertools
import random
import re
import zlib

import pytest

from strataloom.llm import conversations as C
from strataloom.llm.queries import QUERIES

ROLE = {"u": "user", "a": "assistant"}
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def choices(row, fault):
    """(cost, edit, line) of what may become of a turn."""
    out = [(3, "D", None)]
    if fault not in ("blank", "duplicate"):
        more = fault == "truncated"
        out += [(more, "K", (row[2][:1], f"{row[2]}:{row[3]}"))] + [(2 + more, "R", (c, f"{n}:{row[3]}")) for c, n in ROLE.items()]
    return out


GAPS = [tuple(x) for n in range(3) for x in itertools.product("ua", repeat=n)]


def enumerated(rows, found):
    """The cheapest edits out of all, with at most two insertions between turns."""
    best = None
    for picks in itertools.product(*(choices(r, f) for r, f in zip(rows, found))):
        for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
            lines, audit, cost = [], "", 0
            for i, gap in enumerate(gaps):
                lines += [(c, ROLE[c] + ":") for c in gap]
                audit += "I" * len(gap)
                cost += 2 * len(gap)
                if i < len(rows):
                    cost += picks[i][0]
                    audit += picks[i][1]
                    lines += [picks[i][2]] if picks[i][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(c or " " for c, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(x for _, x in lines))
    return best


def searched(rows, found):
    """The cheapest edits by a search over whole strings of edits, one for each way the roles may end."""
    best = {"": (0, "", [])}
    grow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(d, k, v):
        if k not in d or v[:2] < d[k][:2]:
            d[k] = v

    def inserted(states):
        out = {}
        for k, (cost, audit, lines) in states.items():
            put(out, k, (cost, audit, lines))
            for _ in range(2):
                c = grow[k].replace("s", "")
                k, cost, audit, lines = c, cost + 2, audit + "I", [*lines, ROLE[c] + ":"]
                put(out, k, (cost, audit, lines))
        return out

    for row, fault in zip(rows, found):
        after = {}
        # all strings are kept apart by the state they come from, so that prefixes never hide one another
        for k0, v0 in best.items():
            for k, (cost, audit, lines) in inserted({k0: v0}).items():
                for more, edit, line in choices(row, fault):
                    if line is None:
                        put(after, k, (cost + more, audit + edit, lines))
                    elif line[0] and line[0] in grow[k]:
                        put(after, line[0], (cost + more, audit + edit, [*lines, line[1]]))
        best = after
    cost, audit, lines = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    return cost, audit, "\n".join(lines)


def reports(rows, solve=searched):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        cost, audit, text = solve(mine, found) if mine else (0, "", "")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TEXTS = ("Yes.", "No", "", " \n", "Why?", "Ü!\t", None)
ROLES = ("user", "assistant", "system", "user", "assistant", "tool", None, "")


def drawn(n, longest, seed):
    draw = random.Random(seed)
    return [(c, draw.choice((t, t, t, draw.randrange(longest), None)), draw.choice(ROLES), draw.choice(TEXTS)) for c in range(n) for t in range(draw.randrange(1, longest + 1))]


def test_equals_all_edits_of_short_conversations(spark):
    rows = drawn(60, 2, 3)
    want = {k: v for k, v in reports(rows, enumerated).items()}
    assert got(C.op13_conversation_repair(spark.createDataFrame(rows, SCHEMA))) == want


def test_equals_search_on_random_conversations(spark):
    rows = drawn(300, 12, 5) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi")]
    assert got(C.op13_conversation_repair(spark.createDataFrame(rows, SCHEMA).repartition(5))) == reports(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_conversations(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_conversation_repair"](spark, folder)) == reports(rows)


def test_long_conversation_spills_and_leaves_nothing(spark, tmp_path, monkeypatch):
    draw = random.Random(1)
    rows = [(7, t, draw.choice(ROLES), draw.choice(("Yes.", "No", f"Turn {t}."))) for t in range(6000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = got(C.op13_conversation_repair(frame))
    assert got(C.repair(C.damage(frame), spill=64)) == whole
    mine = damaged(rows)
    report = whole[7]
    assert report[1] + report[2] <= report[6].count("D") and len(report[6]) - report[6].count("I") == len(mine)
    pointers = C.Backpointers(12)
    monkeypatch.setattr(C.tempfile, "tempdir", str(tmp_path))
    for i in range(100):
        pointers.add(bytes([i] * 4))
    assert [x[0] for x in pointers.backwards()] == list(range(99, -1, -1)) and not list(tmp_path.iterdir())
    pointers.close()


def test_repaired_turns_have_the_hash_of_the_report(spark):
    rows = drawn(80, 9, 11)
    turns = C.damage(spark.createDataFrame(rows, SCHEMA))
    report = C.repair(turns)
    texts = {}
    for r in sorted(C.repaired(turns, report).collect(), key=lambda r: (r.conv_id, r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in report.collect():
        assert hashlib.sha256("\n".join(texts.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_empty_table_extra_columns_and_a_dropped_conversation(spark):
    assert C.op13_conversation_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Hi.", "x", 1)], SCHEMA + ", audit string, copy int")
    assert got(C.op13_conversation_repair(frame)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
