"""Conversation repair, archives and vector codes against plain versions, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import heapq
import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmetric.llm import codes, repair, warc

# --- conversation repair


def plain_edits(rows):
    """(cost, audit, text) of (role, text, must go, truncated) rows by a shortest-path search over (row, state)."""
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    queue, seen = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, said = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(said)
        need = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(queue, (cost + 5, audit + "I", i, need[1], (*said, f"{need[0]}:")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, said))
            if not gone:
                heapq.heappush(queue, (cost + 1 + 5 * cut, audit + "R", i + 1, need[1], (*said, f"{need[0]}:{text}")))
                to = after.get(role[:1], {}).get(state)
                if to is not None:
                    heapq.heappush(queue, (cost + 5 * cut, audit + "K", i + 1, to, (*said, f"{role}:{text}")))


def plain_repair(rows):
    """The digest of one conversation's (turn, role, text) rows after damage."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, said = plain_edits(marked)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def turns(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return repair.turns_of(frame.withColumns({"key": F.lit("x"), "at": F.lit(1), "part": F.lit("p"), "n": F.lit(0.5), "audit": F.lit("K")}))


def digests(spark, rows):
    got = repair.repair(turns(spark, rows)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["key"]: tuple(r[n] for n in names) for r in got}


def test_runs_and_binary_powers_equal_a_search():
    rng = np.random.default_rng(3)
    for _ in range(300):
        symbols = "".join(rng.choice(list("suaxSUAX-"), rng.integers(0, 9)).repeat(rng.integers(1, 4)))
        rows = [(s.lower() if s not in "-x" else "q", "t", s == "-", s.isupper()) for s in symbols]
        want = plain_edits(rows)
        audit, state, cost = repair.unroll(symbols, 0, repair.ending(), True)
        assert (cost, audit) == want[:2] and state in (0, 3)
        k = int(rng.integers(0, len(symbols) + 1))  # cut anywhere, the pieces give the same
        behind = repair.applied(repair.piece_transition(symbols[k:]), repair.ending())
        first = repair.unroll(symbols[:k], 0, behind, False)
        rest = repair.unroll(symbols[k:], first[1], repair.ending(), True)
        assert first[0] + rest[0] == audit and first[2] + rest[2] == cost
    # one of them deleted, every other one of the rest with a new role
    assert repair.run_transition("u", 1000)[0][2] == 2 + 499 and repair.run_transition("-", 37)[2][2] == 74


def test_conversations_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    roles, said = ["user", "assistant", "system", "tool", "", " ", "unknown", "s"], ["Yes.", "no", "  ", "", "Why?\n", "ok! x", "é.", "Yes.  "]
    rows = []
    for conv in range(60):
        for k in range(int(rng.integers(1, 9))):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 6)) if rng.random() < 0.3 else k
            rows.append((conv if conv else None, turn, str(rng.choice(roles)), str(rng.choice(said))))
    rows += [(7, 3, None, None), (7, 3, None, None), (61, None, "user", "x " * 60_000 + "."), (62, 1, "user", "Hi."), (62, 1, "user", "Hi."), (62, 2, "assistant", "Hi.")]
    got = digests(spark, rows)
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        assert got["" if conv is None else f"={conv}"] == plain_repair(own), conv
    assert repair.repair(turns(spark, [])).count() == 0


def test_a_conversation_over_many_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(1, k, str(rng.choice(["user", "assistant", "system", "tool"], p=[0.45, 0.4, 0.05, 0.1])), str(rng.choice(["Fine.", "cut", "", f"Turn {k}."]))) for k in range(900)]
    rows += [(2, k, "ua"[k % 2] + "x", f"{k}.") for k in range(300)] + [(3, None, "user", "Same.")] * 700
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # short rows would be one part again
    try:
        cut = repair.cut_conversations(repair.in_order(turns(spark, rows)))
        assert "=1" in cut and len(cut["=1"]) > 2
        got = digests(spark, rows)
    finally:
        spark.conf.unset(merge)
    for conv in (1, 2, 3):
        assert got[f"={conv}"] == plain_repair([r[1:] for r in rows if r[0] == conv])


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, 4, 5) for t in (None, *range(60))]
    got = {(r["key"], r["turn"]): (r["role"], r["text"], r["n"]) for r in repair.damaged(turns(spark, rows)).collect()}
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = None if code == 0 else ("user" if code == 4 else role, "" if code == 1 else "One Two Three" if code == 2 else text, 2 if code == 3 else 1)
        assert got.get(("" if c is None else f"={c}", t)) == want


# --- archives


def pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return frame.withColumns({"digest": F.lit("d"), "payload": F.lit(1), "first": F.lit(2), "record_type": F.lit("x"), "path": F.lit("p")})


def round_trip(spark, rows, folder):
    packages, at = warc.archive_pages(pages(spark, rows), f"file://{folder}")
    places = warc.record_places(packages, at)
    return packages, warc.read_records(places, at)


def test_archives_read_back(spark, tmp_path):
    long, other = "<p>é</p>" * 200, "b" * 1000
    rows = [(1, "http://a/é x", long), (2, None, long), (5, "http://c/\r\nX: y", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", ""), (7, "v", other)]
    rows += [(9, "w", other + "!")] * 3 + [(8, "w", other + "!")] + [(9, "x", other + "?"), (9, "y", other + "?"), (None, "z", other + "?")] + [(10, "q", "c" * 999)] * 2
    rows += [(100, "t", "é" * 200_000)]
    packages, records = round_trip(spark, rows, tmp_path / "a")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolved(records).collect()), key=str)
    top = {long: 5, other + "!": 9, other + "?": 9}
    want, held = [], set()
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1] or ""])):
        raw = (html or "").encode()
        kind = "revisit" if html in held else "response"
        held |= {html} if len(raw) >= 1000 else set()
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), kind, top.get(html) if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    urls = {r["url"] for r in records.where("page_id in (1, 5)").collect()}
    assert urls == {"http://a/%C3%A9%20x", "http://c/%0D%0AX:%20y"}
    assert packages.groupBy().sum("records").collect()[0][0] == len(rows)
    assert records.select("record_id").distinct().count() == len(rows)
    for r in packages.collect():  # the packages are plain ZIP files
        with zipfile.ZipFile(tmp_path / "a" / r["path"]) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    empty = warc.archive_pages(pages(spark, []), f"file://{tmp_path}/b")
    assert warc.resolved(warc.read_records(warc.record_places(empty[0], empty[1]), empty[1])).count() == 0


def test_directories_of_zip64_and_others(monkeypatch):
    def package(member_bytes=200, comment=b"", **names):
        sink = io.BytesIO()
        made = warc.Package(sink, "p", member_bytes)
        packed = [warc.warc_record("response", warc.record_id(str(i)), i, "u", hashlib.sha1(b"x" * i).hexdigest(), i, b"x" * i, None) for i in range(12)]
        for p in packed:
            made.add(p)
        made.flush()
        made.zip.comment = comment
        made.close()
        return sink.getvalue(), packed

    def read(raw):
        reads = []

        def at(place, n):
            reads.append(n)
            return raw[place : place + n]

        found = [warc.parse_record(raw[p : p + n])[1] for p, n in warc.package_places(at, len(raw))]
        return found, reads

    want = [b"x" * i for i in range(12)]
    plain, _ = package()
    assert read(plain)[0] == want
    assert read(package(comment=b"PK\x05\x06 no end record " + b"-" * 300)[0])[0] == want
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    wide, _ = package()
    assert b"PK\x06\x06" in wide and b"PK\x06\x07" in wide and read(wide)[0] == want
    monkeypatch.undo()
    # no index: the bounds of the records are found in the member
    sink, (_, packed) = io.BytesIO(), package()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("notes.txt", "x", zipfile.ZIP_DEFLATED)
        z.writestr("archive/a.warc.gz", b"".join(packed))
    assert read(sink.getvalue())[0] == want
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"".join(packed))
    with pytest.raises(ValueError, match="stored"):
        read(sink.getvalue())
    with pytest.raises(ValueError, match="end record"):
        read(b"not a package" * 10)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.record_bounds(lambda at, n: packed[5][at : at + n], 0, len(packed[5]) - 3))


# --- vector codes


def plain_codes(rows, rounds=codes.ROUNDS, entries=codes.ENTRIES):
    """Full rescans with Python integers."""
    kept = [(i, label, [int(np.floor(float(x) * 1024)) for x in v]) for i, label, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // 4
    parts = [[r[2][p * w : p * w + w] for r in kept] for p in range(4)]
    out, books = [], []
    for own in parts:
        book = [list(x) for x in own[:entries]]
        for turn in range(rounds + 1):
            gaps = [[sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book] for x in own]
            code = [g.index(min(g)) for g in gaps]
            if turn < rounds:
                for e in set(code):
                    held = [x for x, c in zip(own, code, strict=True) if c == e]
                    book[e] = [sum(k) // len(held) for k in zip(*held, strict=True)]
        out.append([(c, min(g)) for c, g in zip(code, gaps, strict=True)])
        books += [x for e in book for x in e]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return [(r[0], r[1], "".join(f"{o[k][0]:02x}" for o in out), sum(o[k][1] for o in out)) for k, r in enumerate(kept)], digest


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select("vec_id", "embedding", "label")
    return frame.withColumns({"v": F.lit(1), "code": F.lit("c"), "n": F.lit(2), "gap": F.lit(0), "cell": F.lit(7)})


def test_codes_equal_full_rescans(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), int(rng.integers(0, 4)) if rng.random() < 0.8 else None, [float(x) for x in rng.normal(0, 0.02, 8)]) for i in rng.permutation(420)]
    rows += [(500, 1, None), (501, 1, []), (502, 1, [1.0] * 7 + [None]), (503, 1, [float("nan")] * 8), (504, 1, [float("inf")] * 8), (None, None, [0.5] * 8), (3, 2, [0.25] * 8), (3, 2, [0.25] * 8), (505, 0, [0.1] * 5)]
    want, digest = plain_codes([r for r in rows if r[0] != 505])
    found, books = codes.compress_vectors(vectors(spark, rows))
    got = codes.with_label_errors(found).collect()
    assert sorted(map(str, ((r["vec_id"], r["code"], r["error"]) for r in got))) == sorted(map(str, ((i, c, e) for i, _, c, e in want)))
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    assert sorted(r["label_error"] for r in got) == sorted(sums[label] for _, label, _, _ in want)
    assert codes.books_digest(books) == digest


def test_active_entries_keep_ties():
    rng = np.random.default_rng(11)
    for _ in range(40):
        x, book = rng.integers(-3, 4, (300, 2)), rng.integers(-3, 4, (24, 2))
        code, gap = codes.nearest(x, book)
        following = book.copy()
        for e in rng.choice(24, 8, replace=False):
            following[e] += rng.integers(-1, 2, 2)
        got = codes.reassign(x, following, code, gap, (following != book).any(axis=1))
        want = codes.nearest(x, following)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    big = np.array([[1 << 26, -(1 << 26)], [0, 1]])
    assert codes.nearest(big, np.array([[-(1 << 26), 1 << 26], [0, 0]]))[1].tolist() == [1 << 53, 1]


def test_codes_of_few_and_odd_vectors(spark):
    few = codes.compress_vectors(vectors(spark, [(2, 1, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, 1, [1e300, 0.0, 0.0, 0.0, -1e300])]))
    got = {r["vec_id"]: r["code"] for r in codes.with_label_errors(few[0]).collect()}
    # the fifth component fills the third part, the fourth is all zeros and a tie
    assert got == {1: "00000000", 2: "01010100"} and few[1].shape == (4, 2, 2)
    none = codes.with_label_errors(codes.compress_vectors(vectors(spark, [(1, 1, None)]))[0])
    assert none.columns == ["vec_id", "code", "error", "label_error"] and none.count() == 0
