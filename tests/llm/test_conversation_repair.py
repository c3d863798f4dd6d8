"""Conversation repair against a plain forward search over all edits."""

import hashlib
import random
import zlib

import pytest

from matchgrid.llm import conversation_repair as cr

WHITE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def plain_repair(rows):
    """The contract's columns for one conversation's rows, by a forward search that keeps (cost, letters, turns) of each state."""
    rows = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    add = {"": "user", "s": "user", "a": "user", "u": "assistant"}

    def more(best):
        for _ in range(3):
            for state, (cost, letters, turns) in list(best.items()):
                offer(best, add[state][0], (cost + 2, letters + "I", [*turns, f"{add[state]}:"]))
        return best

    def offer(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        following = {}
        for state, (cost, letters, turns) in more(best).items():
            offer(following, state, (cost + 3, letters + "D", turns))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if (state, role[:1]) in to:
                    offer(following, to[state, role[:1]], (cost + late, letters + "K", [*turns, f"{role}:{text}"]))
                offer(following, add[state][0], (cost + 2 + late, letters + "R", [*turns, f"{add[state]}:{text}"]))
        best = following
    cost, letters, turns = min((v for s, v in more(best).items() if s in ("", "a")), key=lambda v: v[:2])
    known = [t for _, t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(turns).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def found_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def random_rows(rng, conversations, longest, conv=lambda i: i):
    rows = []
    for i in range(conversations):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " ", None, "Ärger"])
            text = rng.choice(["Yes.", "No!", "what", "is it? ", "", " \t\n", None, "a\x00", "?", "Yes.\x0b", "same.", "same.", "long " * 50])
            rows.append((conv(i), rng.choice([turn, turn, turn, turn + 3, turn // 2, None]), role, text))
    return rows


def test_query_equals_plain_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = by_conversation(plain_damage(rows))
    want = {c: plain_repair(left.get(c, [])) for c in {r[0] for r in rows}}
    assert found_of(cr.query(spark, sf_dir)) == want
    assert len({v[6] for v in want.values()}) > 10


def test_whole_query_on_hard_rows(spark, tmp_path):
    rows = random_rows(random.Random(4), 150, 12) + [(None, t, "user", "Who?") for t in (None, 1, 2)] + [(-9, 0, "user", f"only {i}.") for i in range(3)]
    rows += [r for r in rows if r[0] is not None and r[0] % 7 == 0]  # repeated rows and ties
    gone = next(i for i in range(10_000, 20_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "No row is left of this one."))
    spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", cost string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = by_conversation(plain_damage(rows))
    want = {c: plain_repair(left.get(c, [])) for c in {r[0] for r in rows}}
    assert found_of(cr.query(spark, str(tmp_path))) == want
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.query(spark, str(tmp_path)).collect() == []


def test_one_conversation_over_many_partitions(spark):
    """A conversation that holds nearly all rows is repaired in parts, with the same result."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"text {t}.", f"text {t}", "again.", " "])) for t in range(3000)]
    rows += random_rows(rng, 40, 6) + [(7, 5, "user", "copies.")] * 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found, placed = cr.repair(spark.createDataFrame(rows, SCHEMA))
        parts = placed.filter("conv_id = 7").select("part").distinct().count()
        assert parts > 3
        assert found_of(cr.digests(found)) == {c: plain_repair(r) for c, r in by_conversation(rows).items()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repaired_turns_follow_the_pattern(spark):
    import re

    rows = random_rows(random.Random(12), 60, 9)
    found, _ = cr.repair(spark.createDataFrame(rows, SCHEMA))
    for conv, each in by_conversation(found.collect()).items():
        turns = [t for r in sorted(each, key=lambda r: r.place) for t in r.after]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in turns)), conv
        letters = "".join(r.edits for r in sorted(each, key=lambda r: r.place))
        assert len(turns) == len(letters) - letters.count("D") and sum(r.copies for r in each) == len(letters) - letters.count("I")


@pytest.mark.parametrize("size", [1, 2, 3, 10, 100, 1001])
def test_checkpoints_give_the_same_as_all_vectors(size):
    rng = random.Random(size)
    codes = bytes(rng.randrange(12) for _ in range(size))
    vectors = [cr.END]
    for code in reversed(codes):
        vectors.append(cr.step(code, vectors[-1])[0])
    state, plain = cr.NOTHING, []
    for code in codes:
        vectors.pop()
        plain.append(cr.walked(code, vectors[-1], state))
        state = plain[-1][2]
    assert list(cr.repaired(codes, cr.END, cr.NOTHING)) == plain
