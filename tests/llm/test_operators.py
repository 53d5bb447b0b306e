"""Each operator on small hand-made tables: nulls, empties, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarmetric.llm import chat, decontaminate, licenses, neighbours, packing, quality, secrets, sharding, simhash, simhash_wide, urls
from tarmetric.llm.common import literal_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, fp long, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 9.0, "x", 1, "y") for i, t in rows], DOCS)


WORDS = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


# --- quality


def test_quality_learns_and_scores_edges(spark):
    rows = [(k, prose(k) if k % 3 else prose(k).upper().replace(" ", "!! ")) for k in range(240)] + [(None, None), (900, ""), (901, "a " * 30000), (5, prose(5)), (5, prose(5))]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert quality.score_documents(docs(spark, []), labels).count() == 0
    assert {r["score"] for r in quality.score_documents(docs(spark, rows[:4]), labels.limit(0)).collect()} == {0.5}


def test_context_sums_equal_a_plain_loop():
    ids = np.array([3, 5, 3, 9, 5, 5, 1], dtype=np.int32)
    base, total = quality.index_vectors(), np.zeros((quality.BUCKETS + 1, quality.DIMS), dtype=np.int64)
    quality.add_contexts(total, base, ids)
    want = np.zeros_like(total)
    for i, a in enumerate(ids):
        for j in range(max(0, i - 2), min(len(ids), i + 3)):
            want[a] += base[ids[j]] if i != j else 0
    assert (want == total).all()


# --- licenses


def test_license_places(spark):
    rows = [
        (1, "Mit. Released under the MIT License. UNDER THE MIT-LICENSE"), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."),
        (4, "cc by nc cc by nc"), (None, "apache license version 3"), (6, "x " * 40000 + "Apache License, Version 2.0"),
        (7, "the GNU General Public License, version 3"), (8, "ÜNDER the mit license"),
    ]
    got = [tuple(r) for r in licenses.license_digest(licenses.scan_licenses(docs(spark, rows))).collect()]
    by = {(r[0], r[1]): r for r in got}
    assert by[1, 10][2:7] == (2, 2, 6, "mit", "mit") and by[1, 10][7] == 1.0
    assert by[2, 0][1:] == (0, 0, None, None, "", "", 0.0) == by[3, 0][1:]
    assert by[4, 7][2:6] == (1, 2, 2, "cc-by-nc") and by[4, 6][2:5] == (2, 0, 3)
    assert by[None, 4][2] == 0 and by[6, 40005][2:5] == (1, 40000, 40000)
    assert by[7, 7][2] == 0 and by[7, 7][6] == "gpl-3" and by[8, 4][2] == 0
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


# --- urls


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.com/en/x?y"), (2, "https://www.example.com/en/#t"), (3, "http://x.www.example.com/en/"), (4, "http://example.com/fr/"),
        (5, None), (6, "no scheme"), (7, "http://example.com"), (8, "http://q.net/fr/1"), (9, "http://net/es"), (10, "http://notcom/en/"),
        (11, "http://a.net/es/"), (None, "http://a.net/es/"), (11, "http://a.net/es/"), (12, "http://c.com?/x"), (13, "a://b://c.com/"),
    ]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    rules = literal_rows(spark, urls.RULES, "host string,path string,verdict string")
    for run_rows in (1, 20_000):
        got = sorted((r["page_id"] or -1, r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules, run_rows=run_rows).collect())
        assert len(got) == len(rows)
        assert got[0] == (-1, "a.net", "/es/", "net/es/", "block")
        by = {g[0]: g[1:] for g in got}
        assert by[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
        assert by[2][2:] == ("www.example.com/en/", "allow") == by[3][2:]
        assert by[4][2:] == ("com/", "allow") and by[5] == ("", "", None, "allow") == by[6]
        assert by[7] == ("example.com", "", None, "allow") and by[8][2:] == ("net/fr/", "block") and by[9][2] is None and by[10][2] is None
        assert by[12] == ("c.com", "", None, "allow") and by[13][:2] == ("b:", "//c.com/")
    assert urls.judge_urls(pages.limit(0), rules).count() == 0 and urls.judge_urls(pages, rules.limit(0)).where("rule is null").count() == len(rows)


def test_nested_paths_like_brute_force(spark):
    rng = np.random.default_rng(4)
    part = lambda n: "".join(f"/{c}" for c in rng.choice(list("ab"), n))
    rules = sorted({(".".join(rng.choice(["a", "b", "c"], rng.integers(1, 4))), part(rng.integers(0, 4)), "block") for _ in range(60)})
    rows = [(k, f"http://{'.'.join(rng.choice(['a', 'b', 'c'], rng.integers(1, 5)))}{part(rng.integers(0, 6))}") for k in range(300)]
    rules += [("aa", "/", "block"), ("b.aa", "/", "block"), ("", "/", "block")]
    rows += [(300, "http://b.aa/"), (301, "http://ba/"), (302, "http://c.b.aa/x" + "/y" * 50_000), (303, "http://a..b/a"), (304, "http://b./a"), (305, "http:///a")]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), literal_rows(spark, rules, "host string,path string,verdict string"), run_rows=7).collect()}
    assert len(got) == len(rows)
    for k, _ in rows:
        host, path = got[k]["host"], got[k]["path"]
        fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k]["rule"] == (max(fit)[2] if fit else None)


# --- packing


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(1)
    for trial in range(30):
        places = np.unique(np.r_[0, np.cumsum(rng.integers(1, 6, 14))])
        pen = np.where(rng.random(len(places)) < 0.5, 0.0, 3.0)
        pen[-1] = 0
        length, total = 16, int(places[-1])
        best = {0: 0.0}
        for j, p in enumerate(places.tolist()[1:], 1):
            best[p] = min(best[q] + (0 if (w := p - q) == length or (w & (w - 1) == 0) else length - w) for q in best if p - q <= length) + pen[j]
        cuts = packing.cut_windows(places, pen, length, 0)
        cost = sum((0 if (w := b - a) == length or (w & (w - 1) == 0) else length - w) + pen[list(places).index(b)] for a, b in zip(cuts, cuts[1:]))
        assert math.isclose(cost, best[total]) and all(b - a <= length for a, b in zip(cuts, cuts[1:])), trial


def test_packing_gives_pieces_out_by_tokens():
    path = packing.public_tokenizers.path(packing.TOKENIZER)
    text = "The river road is closed near the bridge. " * 400
    given = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": [text] * 400, "_part": pa.array([3] * 400, pa.int32())})
    got = list(packing.packed_batches(iter([given]), path, packing.LENGTH, True))
    sizes = [sum(b["length"].to_pylist()) for b in got]
    assert len(got) > 3 and max(sizes) <= packing.BLOCK + packing.LENGTH
    own = np.concatenate([np.array(p, dtype=np.uint32) for b in got for d, p in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist()) if d == 399])
    assert (own == packing.piece_ids(path).ids(text)).all()
    assert min(b["sequence_id"].to_pylist()[0] for b in got) == 3 << 33


def test_packing_round_trip(spark):
    rows = [(k, prose(k, 300)) for k in range(40)] + [(50, None), (51, ""), (None, "x"), (52, "Ab, it's <|endoftext|> ß漢 1999"), (53, "word" * 9000), (40, "same"), (40, "same")]
    got = packing.pack_documents(docs(spark, rows).coalesce(2)).collect()
    known = packing.piece_ids(packing.public_tokenizers.path(packing.TOKENIZER))
    whole = [np.r_[known.tokenizer.encode(t or "", add_special_tokens=False).ids, 2].astype("<u4") for _, t in rows]
    assert sum(r["length"] for r in got) == sum(map(len, whole))
    for i in (0, 7, 52, 53):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        ids = whole[[d for d, _ in rows].index(i)]
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        sizes.append(sum(n for _, n in pieces))
    assert max(sizes) <= 4096 and sum(4096 - n for n in sizes if n & (n - 1)) < 0.1 * sum(sizes)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_ids_equal_the_tokenizers_on_its_whole_alphabet():
    known = packing.PieceIds(packing.public_tokenizers.path(packing.TOKENIZER))
    letters = [c for c in map(chr, range(0x20, 0x250)) if c.isprintable()] + list("\u2010\u2019\u2026\t\n'")
    rng = np.random.default_rng(17)
    texts = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(30_000)] + [f"a{c}b" for c in letters]
    texts += [x + y for x in letters[:500:7] for y in letters]
    want = known.tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if known.ids(t).tolist() != [*w.ids, 2]]
    assert not wrong, wrong[:5]


def test_blocks_do_not_lose_tokens():
    ids = [np.r_[np.random.default_rng(k).integers(5, 90, 700), 2].astype("<u4") for k in range(30)]
    got = list(packing.pack_stream(zip(range(30), ids), 256, np.array([7, 8]), block=2000))
    for d in range(30):
        own = [g for g in got if g[0] == d]
        assert sum(g[2] for g in own) == 701 and own[0][1] == 0


# --- chat


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nok"), (1, 1, "assistant", "<\\|x <| <\\\\| é"), (1, 1, "assistant", ""), (2, None, "a\nb", "<|nl|>"), (2, 0, None, "t"), (None, 3, "assistant", "z")]
    df = spark.createDataFrame([(*t, "lay", "out") for t in turns], "conv_id long, turn long, role string, text string, layout string, record string")
    records = df.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    got = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(chat.canonical_turns(records))).collect()}
    order = {1: [turns[0], turns[2], turns[1]], 2: [turns[3], turns[4]], None: [turns[5]]}
    for conv, own in order.items():
        said = "".join(f"{r or ''}\n{t}\n" for _, _, r, t in own)
        learnt = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(learnt) and got[conv]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.chat_digest(chat.format_chats(chat.canonical_turns(records.limit(0)))).count() == 0


def test_layouts_by_fingerprint(spark):
    raw = [
        '{"conv_id":1,"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"prompt":"q","conv_id":2,"response":"a"}', '{"conv_id":3,"instruction":"q","input":"i","output":"a"}',
        '{"conv_id":4,"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"conv_id":5,"odd":1}', "broken", None,
    ]
    got = [(r["conv_id"], r["turn"], r["role"], r["text"], r["layout"]) for r in chat.canonical_turns(spark.createDataFrame([(r,) for r in raw], "record string")).collect()]
    assert (1, 0, "user", "q", "messages") in got and (1, 1, "assistant", "a", "messages") in got
    assert (2, 0, "user", "q", "prompt") in got and (3, 0, "user", "q\n\ni", "instruction") in got and (4, 1, "assistant", "a", "exchange") in got
    assert sum(g[4] == "unknown" for g in got) == 3


def test_layouts_with_further_fields_and_other_ids(spark):
    raw = [
        '{"conv_id":"7","prompt":"q","response":"a","source":"s","meta":{"x":[1]}}', '{"conv_id":"c-8","messages":[{"role":"user","content":"q","name":"n"}],"id":3}',
        '{"conv_id":9,"messages":[{"role":"user","content":[{"type":"text","text":"q"},{"type":"text","text":"r"}]},{"role":"assistant","content":"a"}]}',
    ]
    got = [(r["conv_id"], r["turn"], r["role"], r["text"], r["layout"]) for r in chat.canonical_turns(spark.createDataFrame([(r,) for r in raw], "record string")).collect()]
    other = chat.conversation_id("c-8")
    assert {(7, 0, "user", "q", "prompt"), (7, 1, "assistant", "a", "prompt"), (other, 0, "user", "q", "messages"), (9, 1, "assistant", "a", "message_parts")} <= set(got)
    assert (9, 0, "user", "qr", "message_parts") in got and len(got) == 5 and chat.conversation_id(None) is None and chat.conversation_id(1.5) != chat.conversation_id("1.5")


def test_escape_is_reversible():
    rng = np.random.default_rng(2)
    for _ in range(500):
        t = "".join(rng.choice(list("<\\|a>"), rng.integers(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


# --- sharding


def test_shards(spark):
    rows = [(k, "x" * (k % 37)) for k in range(500)] + [(None, None), (7, "é"), (7, "é")] + [(k, "copy of the same text") for k in range(1000, 1300)]
    got = sharding.shard_rows(docs(spark, rows)).collect()
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    assert sorted(r["size"] for r in got) == sorted(sizes) and {r["law"] for r in got} == {"bytes"}
    assert sorted((r["doc_id"] or -1, r["text_crc32"]) for r in got) == sorted((i or -1, zlib.crc32((t or "").encode())) for i, t in rows)
    per = {s: [r for r in got if r["shard"] == s] for s in range(8)}
    for own in per.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - sum(sizes) / 8) <= max(sizes)
    assert sharding.shard_rows(docs(spark, [])).count() == 0


# --- simhash


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, ids, radius):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), 1 << 60), x)
    return [least[root(i)] for i in range(len(fps))]


def test_near_duplicates_like_brute_force(spark):
    rows = [(k, prose(k // 3, 200).replace("wa", "wz", k % 3)) for k in range(60)] + [(70, None), (71, ""), (72, " \n\t"), (73, "One"), (74, "oNE"), (75, "É a b"), (60, prose(1, 9)), (60, prose(1, 9))]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_classes(fps, [i for i, _ in rows], 4)
    assert sorted(got) == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark, [(None, "a"), (None, "a"), (3, "b")])).where("component_id is null").count() == 2


@pytest.mark.parametrize("bucket_rows", [8, 4096])
def test_links_of_dense_and_sparse_fingerprints(spark, bucket_rows):
    rng = np.random.default_rng(bucket_rows)
    heart = int(rng.integers(1 << 62))
    fps = {heart ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 4), replace=False)) for _ in range(150)}
    x = int(rng.integers(1 << 62))
    for _ in range(40):  # a chain
        x ^= sum(1 << int(b) for b in rng.choice(62, 4, replace=False))
        fps.add(x)
    fps = sorted(fps | {int(v) for v in rng.integers(1 << 62, size=60)})
    base = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(base, 4, bucket_rows).collect()}
    assert [got[f] for f in fps] == plain_classes(fps, list(range(len(fps))), 4)


def plain_resemblance(texts, ids, similarity=0.8):
    """Class ids by all pairs of five-word shingle sets."""
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""})
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), 1 << 60), x)
    return [least[root(i)] for i in range(len(sets))]


def edited(text, edits, seed):
    words, rng = text.split(), np.random.default_rng(seed)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


@pytest.mark.parametrize("bucket_rows", [6, 4096])
def test_near_copies_like_brute_force(spark, bucket_rows):
    # single edits touch five shingles: from far above the similarity to far below it
    rows = [(100 * k + e, edited(prose(k, 300), e, 100 * k + e)) for k in range(12) for e in (0, 1, 3, 5, 9, 14, 20)]
    rows += [(5000 + e, edited(prose(77, 400), 2, e)) for e in range(70)] + [(6000, prose(78, 20000)), (6001, prose(78, 20000) + " end")]
    rows += [(7000, None), (7001, ""), (7002, " \n\t"), (7003, "One"), (7004, "oNE"), (7005, "É a b"), (60, prose(1, 9)), (60, prose(1, 9))]
    got = simhash_wide.near_copies(docs(spark, rows), reach=0.9999, bucket_rows=bucket_rows).collect()
    want = plain_resemblance([t for _, t in rows], [i for i, _ in rows])
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(zip([i for i, _ in rows], want))
    assert len(set(want)) > 12


def test_true_pairs_inside_a_family_below_the_similarity(spark):
    # boilerplate: all texts at about 0.7 of each other, and some pairs at 0.8 or more among them
    base, rows = prose(901, 400), []
    for k in range(1500):
        own = edited(base, 7, k)
        rows.append((k, own))
        if k % 8 == 0:
            rows += [(1000000 + k, edited(own, 7, 3000 + k))]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    seen = {}
    for own in sets:
        for x in own:
            seen[x] = seen.get(x, 0) + 1
    place = {x: i for i, x in enumerate(x for x, n in seen.items() if n > 1)}
    held = np.zeros((len(rows), len(place)), dtype=np.float32)
    for i, own in enumerate(sets):
        held[i, [place[x] for x in own if x in place]] = 1
    size, common = np.array(list(map(len, sets))), held @ held.T
    true = np.argwhere(np.triu(common >= 0.8 * (size[:, None] + size[None] - common), 1))
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.near_copies(docs(spark, rows), reach=0.9999).collect()}
    apart = [(i, j) for i, j in true.tolist() if got[rows[i][0]] != got[rows[j][0]]]
    joined = components_of(len(rows), true.tolist())
    assert len(true) > 188 and not apart and len(set(got.values())) == joined


def components_of(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        a, b = label[i], label[j]
        if a != b:
            label = [a if x == b else x for x in label]
    return len(set(label))


@pytest.mark.parametrize("closest", [10, 4096])
def test_spanning_links_connect_what_is_near(closest):
    rng = np.random.default_rng(closest)
    hearts = rng.integers(1 << 63, size=(4, 2), dtype=np.uint64)
    own = np.array([hearts[k % 4] ^ np.array([1 << int(rng.integers(63)), 1 << int(rng.integers(63))], dtype=np.uint64) for k in range(120)])
    a, b = simhash_wide.spanning(own, 6, closest)
    assert len(a) == 116 and all(i % 4 == j % 4 for i, j in zip(a.tolist(), b.tolist())) and len(set(a.tolist()) | set(b.tolist())) == 120
    assert [len(x) for x in simhash_wide.spanning(own[:1], 6, closest)] == [0, 0]


def test_blocks_decide_by_exact_overlaps():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(-40, 40, rng.integers(0, 60))).astype(np.int64) for _ in range(70)]
    sets += [np.arange(20000, dtype=np.int64), np.arange(18000, dtype=np.int64), np.zeros(0, dtype=np.int64)]
    near = simhash_wide.similar(sets, sets[::-1])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[::-1]):
            both = len(np.intersect1d(a, b))
            assert near[i, j] == (5 * both >= 4 * (len(a) + len(b) - both)), (i, j)
    links = np.zeros((6, 5), dtype=bool)
    links[[0, 0, 1, 2, 4, 4], [0, 1, 1, 3, 3, 3]] = True
    a, b = simhash_wide.forest(links)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 3), (4, 3)]


def test_thresholds_reach_the_goal_at_least_cost():
    widths = [16] * 40
    costs = [[0.0, 1.0 + k, 30.0 * (1 + k), 900.0 * (1 + k)] for k in range(40)]
    total, chosen = simhash_wide.allocate(costs, widths, 0.9)
    miss = np.prod([1 - simhash_wide.meeting(16, t) for t in chosen if t >= 0])
    assert miss <= 0.1 and total == sum(c[t + 1] for c, t in zip(costs, chosen))
    assert chosen[0] >= chosen[-1]


def test_keep_one(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "A b c d e"), (9, "q r s"), (None, None), (None, "  ")]
    kept = simhash_wide.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "").strip()) for r in kept.collect()) == [(-1, ""), (3, "a b c d e"), (9, "q r s")]
    assert simhash_wide.keep_one(docs(spark, [])).count() == 0


# --- secrets


def test_secret_spans():
    key = "AKIA" + "Q7" * 9
    text = f'é token = "24be64439e3e49cf46b2d7c9" password: abc passwd=hunter22 {key} AKIAX Api-Key ApiKey:=x PwD is "Xk9#qLw72!zPv"'
    spans, most = secrets.find_spans(text)
    plain = []
    for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        plain += [(m.start(), "assign", m.end())] if len(m[2]) >= 6 else []
    plain += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    plain += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted(s for s in spans if s[1] != "guess") == sorted(plain)
    assert any(text[s:e] == "Xk9#qLw72!zPv" for s, k, e in spans if k == "guess") and most > 60
    assert secrets.find_spans(None) == ([], 0.0) == secrets.find_spans("")


def test_guess_costs():
    weak = ["password", "P@ssw0rd", "aaaaaaaaaaaa", "qwertyuiop", "1234567890", "changeme123", "abcabcabcabc", "20240131"]
    assert all(secrets.guess_bits(w) < secrets.GUESS_BITS for w in weak)
    assert secrets.guess_bits("f33e61083db5dbdf4bd2") > 60 and secrets.guess_bits("") == 0
    assert secrets.guess_bits("passwordQz") <= secrets.guess_bits("password") + secrets.guess_bits("Qz") + 1e-9


def test_secret_digest_and_redaction(spark):
    rows = [(1, 'x token = "24be64439e3e49cf46b2d7c90f" y'), (2, None), (3, ""), (None, "clean"), (1, "z" * 300000)]
    got = secrets.secret_digest(secrets.scan_secrets(docs(spark, rows))).collect()
    assert len(got) == 5 and sum(r["n_assign"] for r in got) == 1 and sum(r["n_hex"] for r in got) == 1
    assert sum(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got) == 4
    one = next(r for r in got if r["n_assign"])
    base = "assign:2:37,hex:11:37"
    assert one["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(one["spans"].split(","))
    clean = {(r["doc_id"], r["text"]): r for r in secrets.redact_secrets(docs(spark, rows)).collect()}
    assert clean[1, 'x [secret]" y']["n_chars"] == len('x [secret]" y') and (None, "clean") in clean and clean[2, None]["n_chars"] is None
    assert secrets.scan_secrets(docs(spark, [])).count() == 0


# --- neighbours


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    heart = rng.normal(size=(30, 16))
    v = heart[rng.integers(30, size=3000)] + 0.5 * rng.normal(size=(3000, 16))
    v[100:400] = v[100]
    rows = [(k, v[k].tolist(), "h", 1) for k in range(3000)] + [(3, v[3].tolist(), "h", 1), (5000, None, "", 0), (5020, [0.0] * 16, "", 0), (5040, [float("nan")] * 16, "", 0), (5060, [1.0] * 15 + [None], "", 0), (5080, [1.0], "", 0), (None, [1.0] * 16, "", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, list int")
    got = neighbours.search(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {k for k in range(0, 3000, 20)}
    hit = 0
    for q, found in by.items():
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(abs(x - s[i]) < 1e-9 for _, i, x in found)
        hit += len(set(want) & {i for _, i, _ in found})
    assert hit / (20 * len(by)) >= 0.9
    assert [i for _, i, _ in sorted(by[200])] == [i for i in range(100, 121) if i != 200][:20]
    few = neighbours.search(df.where("vec_id < 4")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2), (0, 3)]
    assert neighbours.search(df.limit(0)).count() == 0


def test_recall_where_lists_outnumber_the_probes():
    # isotropic vectors are the hardest; in clusters the ratio closes most lists
    rng = np.random.default_rng(6)
    v = rng.normal(size=(30_000, 64))
    recall, scanned, opened = list_recall(v, v[:40])
    assert recall >= 0.93 and opened < 0.5
    heart = 4 * rng.normal(size=(300, 64))
    v = heart[rng.integers(300, size=30_000)] + rng.normal(size=(30_000, 64))
    recall, scanned, closer = list_recall(v, v[:40])
    assert recall >= 0.93 and scanned < 0.5 and closer < opened


def test_walks_find_near_centres():
    rng = np.random.default_rng(8)
    graph = neighbours.CentreGraph(rng.normal(size=(1500, 24)))
    x = rng.normal(size=(30, 24))
    want = np.argsort(neighbours.squared(x, graph.centres), axis=1)[:, :16]
    found, d = graph.search(x)
    assert found.shape == (30, neighbours.OPEN) and (np.diff(d, axis=1) >= 0).all()
    assert np.mean([len(set(a) & set(b[:16])) / 16 for a, b in zip(want, found)]) > 0.95


def list_recall(v, q, k=20):
    """Recall, scanned share of the rows and opened share of the lists, by the operator's own filing and opening."""
    most = (v**2).sum(axis=1).max()
    x = neighbours.lengthened(v, most)
    sample = v[: neighbours.TRAIN_ROWS]
    graph = neighbours.CentreGraph(neighbours.fit_centres(x[: neighbours.TRAIN_ROWS], len(v) // neighbours.LIST_ROWS))
    ratio = neighbours.fitted_ratio(graph, sample, most, len(v))
    filed, homes = [], np.zeros(len(graph.centres), dtype=np.int64)
    for at in range(0, len(x), 512):
        r, lists, home = neighbours.lists_to_file(graph, x[at : at + 512])
        filed.append(np.c_[at + r, lists])
        np.add.at(homes, lists[home], 1)
    filed = np.concatenate(filed)
    rows, lists = neighbours.lists_to_open(graph, homes, np.c_[q, np.zeros(len(q))], ratio, k)
    hit, read = 0, 0
    for i in range(len(q)):
        seen = np.unique(filed[np.isin(filed[:, 1], lists[rows == i]), 0])
        want = np.argsort(-(v @ q[i]), kind="stable")[:k]
        hit += len(set(want.tolist()) & set(seen.tolist()))
        read += len(seen)
    return hit / (k * len(q)), read / (len(v) * len(q)), len(lists) / (len(q) * len(graph.centres))


# --- decontamination


def test_leaks(spark):
    item = "If Anna has 12 apples and buys 30 more at 4 km from home, how many apples does Anna have then?"
    swapped = item.replace("Anna", "Bertha").replace("12", "57").replace("30", "8")
    broken = item.replace("Anna", "Bertha", 1).replace("12", "57")
    bench = spark.createDataFrame([(1, item, "a"), (2, "one two three four five six seven eight", "b"), (3, None, ""), (4, "", ""), (5, "tiny one", ""), (2, "one two three four five six seven eight", "b")], "item_id long, text string, tokens string")
    rows = [(10, prose(1) + " " + item + " " + prose(2)), (11, "Say " + swapped), (12, prose(3)), (13, None), (14, ""), (15, "x ONE two, three four five six seven eight. y"), (15, "x ONE two, three four five six seven eight. y"), (None, "one two three four five"), (16, "a tiny one"), (17, prose(4) + " one two three four nine six seven eight")]
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect())
    assert got == [(10, 1), (11, 1), (15, 2)]
    assert decontaminate.find_leaks(docs(spark, [(1, broken)]), bench).where("item_id = 1 and slot_consistency = 1").count() == 0
    kept = decontaminate.remove_leaked(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 12, 13, 14, 16, 17]
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0 and decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_leaks_in_capitals_with_accents(spark):
    item = "où était l'école près de la forêt où les élèves étudiaient à côté du château"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [(1, prose(1) + " " + item.upper()), (2, prose(2))]), bench).collect()
    assert [(r["doc_id"], r["containment"]) for r in got] == [(1, 1.0)]


def test_leaks_beside_variants_of_the_item(spark):
    item = "yesterday Anna had 12 apples and bought 30 more at 4 km from home so how many apples does Anna have now"
    one, two = item.replace("Anna", "Bertha").replace("12", "57").replace("30", "8"), item.replace("Anna", "Clara").replace("12", "91").replace("30", "66")
    mixed = "yesterday Bertha had 57 apples and bought 8 more at 4 km from home so how many apples does Clara have now"
    rows = "add 3 pears and 5 plums now add 4 pears and 6 plums now add 3 pears and 7 plums now"
    bench = spark.createDataFrame([(1, item), (2, rows)], "item_id long, text string")
    texts = [f"{item}. {prose(1)} {one}", f"{one}. {prose(2)} {two}", f"{prose(3)} {rows}", prose(4)]
    got = decontaminate.find_leaks(docs(spark, list(enumerate(texts))), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 1), (1, 1), (2, 2)]
    assert decontaminate.find_leaks(docs(spark, [(1, mixed)]), bench).where("slot_consistency = 1").count() == 0


def test_leaks_with_names_that_open_sentences_and_long_numbers(spark):
    item = "Anna has 12 apples and 5 pears. Anna buys 30 more apples at 4 km from home. Anna eats 2 of them now."
    texts = [f"{prose(1)} {item.replace('Anna', 'Bertha')}", f"{prose(2)} {item.replace('12', '1,200').replace('30', '3.5')}", f"{prose(3)} {item}", prose(4)]
    got = decontaminate.find_leaks(docs(spark, list(enumerate(texts))), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2]

def test_leaks_by_template_alone_mean_something(spark):
    rng = np.random.default_rng(12)
    numbers = lambda n, low: " ".join(map(str, rng.integers(low, low + 9000, n)))
    bench = spark.createDataFrame([(1, numbers(200, 100)), (2, "name the largest planet"), (3, "Anna lives near Paris and Anna reads 12 books about the sea every long winter")], "item_id long, text string")
    item = "Anna lives near Paris and Anna reads 12 books about the sea every long winter"
    names = [item.replace("Anna", x) for x in ("Mary Ann", "Mary-Ann", "ÉMILE", "Bo")] + [item.replace("Paris", "New York").replace("12", "1,200")]
    texts = [numbers(2000, 20000), "please " + bench.head()["text"], f"{prose(1)} Name the largest planet now {prose(2)}", "name the largest", f"{prose(3)} and {item.replace('Anna', 'Bo', 1).replace('Paris', 'Rome').replace('sea', 'sky')}", *[f"{prose(9 + k)} here {x}." for k, x in enumerate(names)]]
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, list(enumerate(texts))), bench).collect())
    assert got == [(1, 1), (2, 2), *[(5 + k, 3) for k in range(len(names))]]
    # one template many times over is one row for each document and item
    rows = [(k, " ".join(f"row {i} has {i + k} of them now" for i in range(400))) for k in range(3)]
    many = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    windows = decontaminate.item_windows(many)
    assert decontaminate.document_hashes(docs(spark, rows), windows).groupBy("doc_id").count().agg(F.max("count")).head()[0] <= 2 * 7 * 400
    # a column of the caller's stays what it is
    kept = decontaminate.remove_leaked(docs(spark, [(1, prose(5))]).withColumn("_k1", F.lit("mine")).withColumn("_row", F.lit(3)), bench).collect()
    assert [(r["_k1"], r["_row"], r["doc_id"]) for r in kept] == [("mine", 3, 1)]


def plain_words(text):
    return [w for w in re.split(decontaminate.SEPARATOR, text or "") if w]


def test_leaks_like_a_plain_version(spark):
    """All windows of all pairs compared, word for word or by template with slots consistent over the document."""
    rng = np.random.default_rng(21)
    words = ["apple", "tree", "river", "counts", "and", "walks", "to", "of", "small", "Anna", "Bo", "Paris", "Rome", "12", "7", "3.5", "1,200", "km", "days"]

    def typed(text):
        own = plain_words(text)
        kinds = []
        for i, w in enumerate(own):
            number = i > 0 and re.fullmatch(r"[0-9]+([.,][0-9]+)*", own[i - 1])
            kinds.append("u" if number and w in decontaminate.UNITS else "n" if re.fullmatch(r"[0-9]+([.,][0-9]+)*", w) else "p" if w[0].isupper() and len(w) > 1 and w.isalpha() else None)
        out = [(k, w.lower()) for i, (w, k) in enumerate(zip(own, kinds, strict=True)) if not (k == "p" and i + 1 < len(own) and kinds[i + 1] == "p")]
        return [w.lower() for w in own], out

    def windows(seq):
        return [tuple(seq[i : i + 5]) for i in range(max(1, len(seq) - 4))] if seq else []

    def leaks(text, item):
        (dw, dt), (iw, it) = typed(text), typed(item)
        if len(iw) < 5 or not dw:
            return False
        held = set(windows(dw))
        if sum(w in held for w in windows(iw)) >= 0.8 * len(windows(iw)):
            return True
        shape = lambda w: tuple(k or x for k, x in w)
        fit = lambda w: sum(k is None for k, _ in w) >= 2
        by = {}
        for at, w in enumerate(windows(dt)):
            if fit(w):
                by.setdefault(shape(w), []).append((at, w))
        own = [(at, w) for at, w in enumerate(windows(it)) if fit(w)]
        if sum(shape(w) in by for _, w in own) < 0.8 * len(windows(it)):
            return False
        spots = {None: {}}
        count = {}
        for at, w in own:
            for d, x in by.get(shape(w), []):
                count.setdefault(d - at, set()).add(at)
                for place in (None, d - at):
                    for (k, a), (_, b) in zip(w, x, strict=True):
                        if k:
                            spots.setdefault(place, {}).setdefault(a, set()).add(b)
        scores = [np.mean([len(v) == 1 for v in values.values()]) if values else 1.0 for place, values in spots.items() if place is None or len(count[place]) >= 0.8 * len(windows(it))]
        return max(scores) >= 0.8

    items = [" ".join(rng.choice(words, rng.integers(6, 16))) for _ in range(30)]
    texts = []
    for k in range(120):
        own = items[k % 30].split()
        for i in range(len(own)):
            if rng.random() < 0.12:
                own[i] = str(rng.choice(words))
        swap = {"Anna": "Zoe", "12": "99", "Rome": "Oslo"} if k % 3 == 0 else {}
        texts.append(" ".join(rng.choice(words, 20)) + " " + " ".join(swap.get(w, w) for w in own))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, list(enumerate(texts))), bench).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if leaks(t, x)}
    assert got == want and 10 < len(want) < 110
