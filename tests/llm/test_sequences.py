"""Fill-in-the-middle, periodic runs and rank BPE against plain versions and the library."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marketloom.llm import fill_in_middle, periodic_runs, queries, rank_bpe

RANKS = public_tokenizers.path(queries.RANKS)
SHAPE = "doc_id long, text string, n long, form string, runs int, ids string"
SF = "/root/testdata/sf0.001"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß日😀'1<>PSM") for _ in range(rng.randint(1, 7)))
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é"), (6, "a <P> in a text"), (7, "<S>"), (8, "<M>" * 40), (None, "an id is missing here, twice"), (9, "twice " * 40),
        (9, "twice " * 40), (9, "another text of nine"), (10, "日本語😀" * 50), (11, "a b c\x00d\x1c\x85 \xa0 e\r\n\n  f"), (12, "x" * 5000), (13, "<|endoftext|> it's I'll don't  "),
    ]
    rows += [(20 + i, " ".join(word() for _ in range(rng.randint(1, 90)))) for i in range(120)]
    for i in range(60):  # loops in loops
        part = [word() for _ in range(rng.randint(1, 9))]
        rows.append((200 + i, "\t".join((part * rng.randint(2, 20) + [word()] + part[:2] * rng.randint(1, 20)) * rng.randint(1, 4))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash", 1, "x") for i, t in rows], SHAPE).repartition(3).cache()


def keyed(found) -> list[tuple]:
    return sorted(map(tuple, found), key=repr)


def plain_fill(i: int | None, text: str | None) -> tuple:
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, t
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_rearranged_texts(docs, rows):
    want = [plain_fill(i, t) for i, t in rows]
    found = fill_in_middle.rearrange(docs)
    assert keyed(found.collect()) == keyed(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = fill_in_middle.digest(found).collect()
    assert keyed((r.doc_id, r.output_sha256, r.restored_sha256) for r in got) == keyed((w[0], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True))


def test_rank_and_select():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        for share in (0.0, 0.01, 0.5, 1.0):
            bits = rng.random(n) < share
            v = fill_in_middle.Bits(bits)
            assert v.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
            ones = np.flatnonzero(bits)
            assert v.select(np.arange(len(ones))).tolist() == ones.tolist()


def plain_runs(w: list, least: int, times: int) -> list[tuple[int, int, int]]:
    """Every period is tried at every word."""
    ends: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                ends.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in ends.items())


def kept(w: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs(docs, rows):
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect()]
    want = []
    for i, t in rows:
        w = split(t)
        runs = plain_runs(w, 24, 3)
        want.append((i, len(w), runs, kept(w, runs)))
    assert sum(len(x[2]) for x in want) > 60
    assert keyed(got) == keyed(want)


def test_runs_of_random_words_in_small_groups(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    for _ in range(150):
        given = []
        for _ in range(rng.randint(1, 5)):
            k, t = rng.choice([1, 2, 3, 9]), []
            for _ in range(rng.randint(0, 5)):
                t += ([b"%d" % rng.randrange(k) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9))[: rng.randint(1, 90)]
            given.append(t)
        w, starts = periodic_runs._numbered(given)
        for least, times in ((24, 3), (4, 2)):
            want = [(int(a) + s, n, p) for t, a in zip(given, starts, strict=False) for s, n, p in plain_runs(t, least, times)]
            assert periodic_runs.maximal_runs(w, least, times) == sorted(want)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for t in (fibonacci[-1], "a" * 3000, "ab" * 800 + "a" * 900):
        w, _ = periodic_runs._numbered([[c.encode() for c in t]])
        assert periodic_runs.maximal_runs(w) == plain_runs(list(t), 24, 3)


def looped(i: int | None, text: str | None) -> list[str]:
    w = split(text)
    h = 1 if i is None else zlib.crc32(str(i).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]


def plain_digest(i: int | None, text: str | None) -> tuple:
    w = looped(i, text)
    runs = plain_runs(w, 24, 3)
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept(w, runs)))


def test_digest_of_looped_texts(docs, rows):
    got = periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_loops(docs))).collect()
    assert keyed(got) == keyed(plain_digest(i, t) for i, t in rows)


def test_the_query_on_whole_tables(spark):
    got = queries.op12_periodic_runs(spark, SF).collect()
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert keyed(got) == keyed(plain_digest(*r) for r in given)
    assert sum(r.n_runs for r in got) > 10


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def coded(library, rows) -> list[tuple]:
    out = []
    for i, t in rows:
        ids = array("I", library.encode_ordinary(t or ""))
        out.append((i, len(ids), sha(ids.tobytes()), sha(t or "")))
    return out


def test_ids_and_round_trip(docs, rows, library):
    encoded = rank_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert keyed(rank_bpe.digest(rank_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)).collect()) == keyed(coded(library, rows))


def test_the_bpe_query_on_whole_tables(spark, library):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert keyed(queries.op13_rank_bpe(spark, SF).collect()) == keyed(coded(library, map(tuple, given)))


def test_backtracking_equals_the_merges(library):
    own = rank_bpe.RankBpe(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(3000):
        piece = b"".join(rng.choice(own.tokens) for _ in range(rng.randint(2, 5)))
        letters = rng.choice([b"ab", b"aeinrst", bytes(range(256)), b" \n", b"=-_"])
        for p in (piece, bytes(rng.choice(letters) for _ in range(rng.randint(2, 40)))):
            if p not in own.ranks:
                assert own.encoded(p) == own.merged(p) == list(library._encode_single_piece(p))
    for _ in range(20_000):
        a, b = rng.randrange(len(own.tokens)), rng.randrange(5000)
        assert own._fit(a, b) == (own.merged(own.tokens[a] + own.tokens[b]) == [a, b])


def test_stretches_and_other_patterns(library):
    own = rank_bpe.RankBpe(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("ab \x1c\x85\xa0 \n\té日's1!\0") for _ in range(rng.randint(0, 40)))
        whole = array("I", library.encode_ordinary(t)).tobytes()
        assert own.ids(t) == whole and b"".join(own.ids(p) for p in rank_bpe.stretches(t, 4)) == whole
        assert own.decoded(whole) == t.encode()
    other = rank_bpe.RankBpe(RANKS, r"\S+|\s+")
    assert not other.plain and other.decoded(other.ids("a  b c's\n")) == b"a  b c's\n"


def test_long_texts(spark, library):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "x1", "é"]) for _ in range(300_000))
    rows = [(1, long), (2, "y" * 2_000_000), (3, "spam " * 400_000), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert keyed(fill_in_middle.rearrange(df).collect()) == keyed(plain_fill(i, t) for i, t in rows)
    got = {r.doc_id: r for r in periodic_runs.find_runs(df).collect()}
    assert [tuple(x) for x in got[3].runs] == [(0, 400_000, 1)] and got[3].collapsed == "spam" and got[2].n_words == 1
    encoded = rank_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert keyed(rank_bpe.digest(rank_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)).collect()) == keyed(coded(library, rows))


def test_empty_tables(docs):
    none = docs.filter("doc_id < 0")
    assert fill_in_middle.digest(fill_in_middle.rearrange(none)).count() == 0
    assert periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_loops(none))).count() == 0
    encoded = rank_bpe.encode(none, RANKS, public_tokenizers.PATTERN)
    assert rank_bpe.digest(rank_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)).count() == 0
