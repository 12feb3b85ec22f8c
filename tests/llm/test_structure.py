"""Conversation repair, prefix trie and WARC archives against brute-force versions, and on odd rows."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kindling.llm import common, conversation_repair as repair, ordered, prefix_trie as trie, warc

from ..conftest import SF_SMALL

TURNS = "conv_id long, turn long, role string, text string, rank long, node string, fault int"
NOTHING = hashlib.sha256().hexdigest()


@pytest.fixture(scope="module")
def conversations(spark):
    return common.table(spark, SF_SMALL, "conversations")


@pytest.fixture(scope="module")
def odd_turns(conversations):
    """Nulls in any column, ties, repeated rows, blank and very long texts, unknown roles, extra columns."""
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "assistant", "a"), (1, None, None, None), (2, 3, "user", None), (3, None, "system", "S!"),
            (None, 0, "user", "q?"), (None, 1, "assistant", "a."), (4, 5, "", "x."), (4, 5, "tool", "y"), (4, 6, "", ""), (5, 0, "assistant", " \t\n"),
            (-7, 1, "user", "word. " * 50_000), (-7, 2, "assistant", "w" * 300_000), (6, 2**62, "user", "big."), (6, -(2**62), "user", "small."), (6, 2**63 - 1, "user", "end."), (6, -(2**63), "user", "start."),
            (10, 0, "user", "Same."), (11, 0, "user", "Same."), (12, 0, "user", "Same."), (12, 1, "assistant", "Same."), (13, 0, "user", "日本 🙂."), (14, 9, "system", "Only.")]
    return lambda spark: spark.createDataFrame([(*r, 7, "x", 1) for r in rows], TURNS).repartition(3)


def _by_conv(df, null):
    out = collections.defaultdict(list)
    for r in df.select("conv_id", "turn", "role", "text").collect():
        out[r.conv_id].append((r.turn is not None, r.turn, null if r.role is None else r.role, null if r.text is None else r.text))
    return out


def _order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def _least(rows):
    """All edit sequences by rising cost, letters kept as text: no weights, no states."""
    ok = re.compile(r"(s?(ua)+)?")
    best = {(0, ""): (0, "", ())}  # (rows done, initials) -> least (cost, audit, lines)
    done = {}
    live = best
    # between rows and at the ends two inserts at most can pay: a third would repeat a pair
    def widen(found):
        for _ in range(2):
            for (i, roles), (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    new = roles + role[0]
                    if re.fullmatch(r"s?(ua)*u?", new):
                        key = (i, _short(new))
                        cand = (cost + 2, audit + "I", (*lines, f"{role}:"))
                        if key not in found or cand[:2] < found[key][:2]:
                            found[key] = cand
        return found

    def _short(roles):  # initials that continue alike are one
        return "" if not roles else "s" if roles == "s" else "u" if roles[-1] == "u" else "ua"

    live = widen(live)
    for i, (role, text, kind) in enumerate(rows):
        new = {}
        for (_, roles), (cost, audit, lines) in live.items():
            ways = [(cost + 3, audit + "D", lines, roles)]
            if kind != 2:
                ways += [(cost + kind, audit + "K", (*lines, f"{role}:{text}"), roles + role[:1])] if role else []
                ways += [(cost + 2 + kind, audit + "R", (*lines, f"{to}:{text}"), roles + to[0]) for to in ("user", "assistant")]
            for c, a, ls, rs in ways:
                if re.fullmatch(r"s?(ua)*u?", rs):
                    key = (i + 1, _short(rs))
                    if key not in new or (c, a) < new[key][:2]:
                        new[key] = (c, a, ls)
        live = widen(new)
    for (_, roles), found in live.items():
        if ok.fullmatch(roles):
            done[roles] = found
    return min(done.values())


def _all_sequences(rows):
    """Truly exhaustive, for a few rows: every choice of edits with at most two inserts in each gap."""
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    for edits in itertools.product(*[["D"] if k == 2 else ["D", "K", "u", "a"] for _, k in rows]):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles = audit = ""
            cost = 0
            for g, (e, row) in itertools.zip_longest(ins, zip(edits, rows, strict=True), fillvalue=(None, None)):
                roles, audit, cost = roles + "".join(g), audit + "I" * len(g), cost + 2 * len(g)
                if e == "D":
                    audit, cost = audit + "D", cost + 3
                elif e:
                    audit, cost, roles = audit + ("K" if e == "K" else "R"), cost + row[1] + (0 if e == "K" else 2), roles + (row[0] if e == "K" else e)
            if re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_least_edits_exhaustively():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice((0, 0, 1, 2))) for _ in range(rng.randint(0, 3))]
        assert repair.least_edits(rows) == _all_sequences(rows), rows


def test_stretches_fold_to_the_whole():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("ssuuaax"), rng.choice((0, 0, 0, 1, 2))) for _ in range(rng.randint(1, 40))]
        cuts = sorted(rng.sample(range(1, len(rows)), rng.randint(0, len(rows) - 1) if len(rows) > 1 else 0))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        t = repair.START
        for p in parts:
            t = repair.fold(t, repair._unpacked(repair._packed(repair.stretch_table(p, range(4), False))))
        want = _least([({"s": "system", "u": "user", "a": "assistant", "x": "x"}[i], "", k) for i, k in rows])
        assert repair.cheapest(t) == repair.least_edits(rows) == want[:2]


def _repaired(df):
    """{conv_id: row} of the contract, plainly."""
    out = {}
    for conv, rows in _by_conv(df, " ").items():
        kept = []
        for has, turn, role, text in rows:
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{turn if has else ' '}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(has, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
        kept, seen, kinds, n = _order(kept), set(), [], collections.Counter()
        for _, _, role, text in kept:
            body = text.rstrip("\t\n\x0b\x0c\r ")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            kinds.append((role, text, {"": 0, "truncated": 1}.get(fault, 2)))
        cost, audit, lines = _least(kinds)
        turns = [r[1] for r in kept if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        out[conv] = (gaps if gaps < 2**63 else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _got_repairs(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_repair(spark, conversations, odd_turns):
    for df in (conversations, odd_turns(spark)):
        assert _got_repairs(repair.repaired_after_damage(df)) == _repaired(df)
    none = repair.repaired_after_damage(conversations.limit(0))
    assert none.count() == 0 and {"conv_id", "audit", "repaired_sha256"} <= set(none.columns)


def test_repair_of_a_hot_conversation(spark, conversations):
    """A conversation with most of the rows crosses tasks and stretches, and one row repeats a thousand times."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"Text {t}.", "", f"more {t}"])) for t in range(900)]
    rows += [(1, 450, "user", "Again.")] * 1000 + [(c, t, "user", "Hm.") for c in (0, 2) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = _repaired(df)
    for stretch, fan in ((64, 4), (256, 64)):
        assert _got_repairs(repair.repaired_after_damage(df, stretch, fan)) == want


def _halves(role, text):
    """Equal turns follow the digest's halves as signed longs."""
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 8], "big", signed=True) for k in (0, 8))


def _nodes(df):
    own = {c: [(r[2], r[3]) for r in sorted(rows, key=lambda r: (r[0], r[1] or 0, _halves(r[2], r[3])))]
           for c, rows in _by_conv(df, "").items() if c is not None}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    return collections.Counter(
        (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p)).encode()).hexdigest()) for p, cs in members.items())


def _got_nodes(df):
    return collections.Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie(spark, conversations, odd_turns):
    assert _got_nodes(trie.prefix_trie(conversations)) == _nodes(conversations)
    assert _got_nodes(trie.prefix_trie(conversations, list_max=8)) == _nodes(conversations)  # every round of contraction
    assert trie.prefix_trie(conversations.limit(0)).count() == 0
    assert _got_nodes(trie.prefix_trie(odd_turns(spark))) == _nodes(odd_turns(spark))


def test_trie_with_a_hot_conversation_and_a_hot_first_turn(spark, conversations):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(700)] + [(c, 0, "user", "Same first turn") for c in range(20, 400)]
    rows += [(c, 1, "assistant", f"reply {c % 50}") for c in range(20, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert _got_nodes(trie.prefix_trie(df, list_max=64)) == _nodes(df)


def test_running(spark, conversations):
    """Ranks, running xors and the value before, where one group spans all partitions."""
    rng = random.Random(7)
    rows = [(g, i, rng.getrandbits(63) - 2**62) for g, n in ((0, 3), (1, 3000), (2, 1), (9, 40)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(3)
    got = ordered.running(df, "g", ["i"], common.Scratch(spark, "t"), "t", xors=["v"], previous="i")
    want, acc = set(), collections.Counter()
    for g, i, v in sorted(rows):
        acc[g] ^= v
        want.add((g, i, v, i + 1, acc[g], i - 1 if i else None))
    assert {(r.g, r.i, r.v, r["rank"], r.x_v, r.before) for r in got.collect()} == want


PAGES = "page_id long, url string, html string, row long, first string, digest int"


def _pages(df):
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in df.select("page_id", "url", "html").collect()]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    out = collections.Counter()
    for payload, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, r in enumerate(rs):
            out[(r[0], len(payload), digest, "revisit" if k else "response", rs[0][0] if k else None)] += 1
    return out


def _read(spark, path):
    got = warc.read_archives(spark, path).collect()
    records = [r for r in got if r.kind == "record" and r.record_type in ("response", "revisit")]
    return records, [r for r in got if r.kind == "gap"]


@pytest.mark.parametrize("compressed", [True, False])
def test_archives(spark, conversations, tmp_path, compressed):
    pages = common.table(spark, SF_SMALL, "pages")
    inner = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"
    odd = [(1, "u", None), (2, "u", ""), (2, "v", ""), (None, "w", ""), (None, None, "x"), (3, "a b\r\nX: y", inner * 3), (4, "ü", "日本 🙂"), (5, "u", "big " * 400_000),
           (6, "u", "big " * 400_000), (6, "u", "big " * 400_000), (7, "z", "\x1f\x8b\x08 \r\n\r\n")]
    odd = spark.createDataFrame([(*r, 1, "x", 2) for r in odd], PAGES).repartition(3)
    for k, df in enumerate((pages, odd, pages.limit(0))):
        path = str(tmp_path / f"w{k}")
        warc.write_archives(df, path, archive_bytes=50_000, compressed=compressed)
        records, gaps = _read(spark, path)
        assert not gaps
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == _pages(df)
        texts = collections.Counter((r.html or "").encode() for r in df.collect())
        assert {bytes(r.payload) for r in records if r.record_type == "response"} == set(texts)
    few = str(tmp_path / "few")
    warc.write_archives(odd, few, min_bytes=1, compressed=compressed)  # smaller payloads are all responses
    assert sum(r.record_type == "response" and r.payload_bytes == 0 for r in _read(spark, few)[0]) == 4


def test_archives_are_plain_gzip(spark, conversations, tmp_path):
    pages = common.table(spark, SF_SMALL, "pages")
    warc.write_archives(pages, str(tmp_path / "w"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").rglob("part-*"))
    assert whole.count(b"WARC-Type: response") + whole.count(b"WARC-Type: revisit") == pages.count() and whole.endswith(b"\r\n\r\n")


def _archive(compressed, n=30):
    rng, parts = random.Random(8), []
    for k in range(n):
        text = " ".join(rng.choice(["alpha", "beta", "WARC/1.1", "\r\n\r\n", "gamma"]) for _ in range(rng.randint(0, 60))).encode()
        data = warc.page_record(k, k, f"http://x/{k}", text, None) + warc.RECORD_END
        parts.append(warc.gzip_member(data) if compressed else data)
    return parts


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage(compressed):
    """Records that damage doesn't touch are all found; gaps and records tile the archive."""
    parts, rng = _archive(compressed), random.Random(9)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    for trial in range(150):
        data, hit = bytearray(b"".join(parts)), set()
        kind = trial % 5
        if kind == 0:  # a flipped bit
            at = rng.randrange(len(data))
            data[at] ^= 1 << rng.randrange(8)
            hit = {k for k in range(len(parts)) if starts[k] <= at < starts[k + 1]}
        elif kind == 1:  # the end is cut off
            at = rng.randrange(len(data))
            del data[at:]
            hit = {k for k in range(len(parts)) if starts[k + 1] > at}
        elif kind == 2:  # bytes lost in the middle
            at, n = rng.randrange(len(data)), rng.randint(1, 400)
            del data[at:at + n]
            hit = {k for k in range(len(parts)) if starts[k] < at + n and at < starts[k + 1]}
        elif kind == 3:  # foreign bytes between two records
            data[starts[(k := rng.randrange(len(parts)))]:starts[k]] = rng.randbytes(rng.randint(1, 300))
        else:  # zeros over a stretch
            at, n = rng.randrange(len(data)), rng.randint(1, 900)
            n = min(n, len(data) - at)
            data[at:at + n] = bytes(n)
            hit = {k for k in range(len(parts)) if starts[k] < at + n and at < starts[k + 1]}
        found = list(warc.scan_archive(bytes(data)))
        got = [r["page_id"] for kind_, *_, r in found if kind_ == "record"]
        sound = set(range(len(parts))) - hit
        assert sound <= set(got) and len(got) == len(set(got)), (trial, kind)
        for page in set(got) - sound:  # only a byte that nothing checks (a date's, a gzip header's time) may differ
            assert kind in (0, 4, 2, 1)
        at = 0
        for _, start, end, reason, _ in found:
            assert start == at and end > start
            at = end
        assert at == len(data)
        if kind == 3:
            assert [f[0] for f in found].count("gap") == 1


def test_damaged_archive_through_spark(spark, conversations, tmp_path):
    parts = _archive(True)
    bad = b"".join(parts[:10]) + parts[10][:25] + b"\0" * 40 + b"".join(parts[11:])
    (tmp_path / "part-0.warc.gz").write_bytes(bad)
    (tmp_path / "part-1.warc").write_bytes(b"".join(_archive(False, 5)))
    records, gaps = _read(spark, str(tmp_path))
    assert sorted(r.page_id for r in records) == sorted([*range(10), *range(11, 30), *range(5)])
    assert [(g.archive.rsplit("/", 1)[1], g.start, g.end) for g in gaps] == [("part-0.warc.gz", sum(map(len, parts[:10])), sum(map(len, parts[:10])) + 65)]
    assert gaps[0].reason in ("bad gzip member", "truncated")
