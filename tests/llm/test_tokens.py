"""Operators on tokens and phrases against the libraries and brute force, with awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunfold.llm import alignment, bpe_trie, collocations, queries, spm_chunks

ODD = [
    (10**9, None, "en"), (10**9 + 1, "", "en"), (10**9 + 2, " ", None), (10**9 + 3, " a  b ", "und"), (10**9 + 4, "a▁b ▁c\n\n x", "fr"), (10**9 + 5, "日本 語 \U0001f600 \x00 z   ", None),
    (10**9 + 6, "<|endoftext|>x<|endoftext|> <s> </s>", "en"), (None, "don't We'LL 12 a1 ½ ²౜ ࢏", "en"), (10**9 + 3, " a  b ", "und"), (10**9 + 8, "w" * 50_000 + " x" * 300, "de"), (10**9 + 9, "<unk> <0x41> \r\n\t\x0b. ;: a", "en"),
]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, small):
    """Real rows, awkward ones, and extra columns with clashing names."""
    x = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string"), allowMissingColumns=True)
    names = ("ids", "decoded", "n_a", "n_b", "block", "kind", "payload", "pair", "best", "count", "which", "many", "word", "id", "f", "rank", "score", "hi", "c0", "text_")
    return x.withColumns({c: F.lit(i) for i, c in enumerate(names)})


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_model())


@pytest.fixture(scope="module")
def bpe():
    return bpe_trie.loaded(open(queries.byte_model(), encoding="utf-8").read())


def test_bpe_equals_library(spark, docs, pairs, library):
    got = bpe_trie.encode_decode(docs, queries.byte_model())
    assert set(got.columns) == set(docs.columns)
    rows = sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in got.select("doc_id", "ids", "decoded").collect())
    want = [(str(k), library.encode(t or "", add_special_tokens=False).ids) for k, t in pairs]
    assert rows == sorted((k, i, library.decode(i, skip_special_tokens=False)) for k, i in want)
    assert [r["c0"] for r in got.select("c0").distinct().collect()] == [18]
    one = spm_chunks.digests(bpe_trie.encode_decode(spark.createDataFrame([(1, "a b<|endoftext|>")], "doc_id long, text string"), queries.byte_model())).first()
    ids = library.encode("a b<|endoftext|>", add_special_tokens=False).ids
    assert 50256 in ids and tuple(one) == (1, len(ids), sha(",".join(map(str, ids))), sha("a b<|endoftext|>"))
    assert bpe_trie.encode_decode(docs.limit(0), queries.byte_model()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinrst th'1 \n-="))))
def test_bpe_of_any_text(text):
    from tokenizers import Tokenizer

    spec = open(queries.byte_model(), encoding="utf-8").read()
    bpe, library = bpe_trie.loaded(spec), _once(Tokenizer.from_str, spec)
    ids, _ = bpe.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and bpe.decode(ids) == text


_made = {}


def _once(f, x):
    return _made.setdefault(f, f(x)) if f not in _made else _made[f]


def test_bpe_words_split_as_the_library_does(bpe, library):
    """Every character beside letters, digits, signs and at an end."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (bpe_trie._SETTLED.fullmatch(chr(c)) or c % 97 == 0)]
    for at in range(0, len(chars), 500):
        text = "".join(f"a{c}a 1{c}1 .{c}. {c}{c} " for c in chars[at : at + 500])
        assert bpe.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_bpe_pairs_stay_apart_as_when_merged(bpe, library):
    rng = random.Random(3)
    ids = sorted(bpe.built.values())
    plain = [i for i in ids if bpe.bytes_of[i].isalpha()]
    for _ in range(3000):
        a, b = rng.choice(plain), rng.choice(plain)
        s = (bpe.bytes_of[a] + bpe.bytes_of[b]).decode()
        assert bpe.stay_apart(a, b) == (library.encode(s, add_special_tokens=False).ids == [a, b])
    assert len(ids) == 50256


def test_bpe_shared_prefixes_are_computed_once(bpe, monkeypatch):
    """Words that go on from one prefix ask only about what follows it."""
    asked = []
    monkeypatch.setattr(bpe, "stay_apart", lambda a, b, f=bpe.stay_apart: asked.append(1) or f(a, b))
    bpe._apart.clear()
    word = b"abcdefgh" * 500
    list(bpe.traverse([word]))
    alone = len(asked)
    asked.clear()
    bpe._apart.clear()
    got = list(bpe.traverse(sorted(word + bytes([97 + i]) for i in range(20))))
    assert len(got) == 20 and len(asked) < 2 * alone + 400


def test_bpe_refuses_models_it_cannot_traverse():
    import json

    x = json.load(open(queries.byte_model(), encoding="utf-8"))
    with pytest.raises(ValueError):
        bpe_trie.ByteBpe(json.dumps(x | {"normalizer": {"type": "NFC"}}))


def brute_alignment(texts, library, sp):
    """The contract's columns for each text, token by token."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(library.to_str())
    plain.encode_special_tokens = True
    byte = bpe_trie._byte_of_char()
    out, count = [], Counter()
    for t in texts:
        a = [(i, bytes(byte[c] for c in plain.id_to_token(i))) for i in plain.encode(" " + (t or ""), add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(t or "")] if t else []
        if not t or b"".join(s for _, s in a) != (" " + t).encode() or b"".join(s for _, s in b) != (" " + t).encode():
            out.append(None)
            continue
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, s in tokens:
                own.append((i, at, at + len(s)))
                at += len(s)
            spans.append(own)
        links, j = [], 0
        for i, x, y in spans[0]:
            while spans[1][j][2] <= x:
                j += 1
            m = j
            while m < len(spans[1]) and spans[1][m][1] < y:
                links.append((i, spans[1][m][0]))
                m += 1
        closed = sorted({y for _, _, y in spans[0]} & {y for _, _, y in spans[1]})
        groups, low = [], 0
        for high in closed:
            groups.append("|".join(",".join(str(i) for i, x, y in own if low <= x and y <= high) for own in spans) if len(closed) < 400 else "")
            low = high
        out.append((len(a), len(b), len(closed), links, ";".join(groups) if len(closed) < 400 else None))
        count.update(links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for o in out:
        if o is None:
            rows.append((0, 0, 0, 0, "", 0, 0))
        else:
            rows.append((*o[:3], len(o[3]), o[4], sum(count[p] == most[p[1]] for p in o[3]), sum(count[p] for p in o[3])))
    return rows


@pytest.mark.parametrize("block_mb", [0, 16])
def test_alignment_equals_brute_force(docs, pairs, library, block_mb):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=queries.piece_model())
    want = brute_alignment([t for _, t in pairs], library, sp)
    got = alignment.align(docs, queries.byte_model(), queries.piece_model(), groups="text", block_mb=block_mb)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert set(got.columns) == set(docs.columns) | set(names)
    short = lambda r: tuple(r[:4]) + tuple(r[5:])
    rows = got.select("doc_id", *names).collect()
    assert sorted((str(r[0]), *short(r[1:])) for r in rows) == sorted((str(k), *short(w)) for (k, _), w in zip(pairs, want, strict=True))
    said = {str(k): w[4] for (k, _), w in zip(pairs, want, strict=True) if w[4] is not None}
    assert len(said) > 20 and all(said[str(r[0])] == r["groups"] for r in rows if str(r[0]) in said)
    digest = alignment.align(docs, queries.byte_model(), queries.piece_model(), block_mb=block_mb).select("doc_id", "groups_sha256").collect()
    assert sorted(map(str, digest)) == sorted(str(type(digest[0])(doc_id=r[0], groups_sha256=sha(r["groups"]) if r["groups"] else "")) for r in rows)


def test_alignment_of_nothing_and_nulls(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, queries.byte_model(), queries.piece_model()).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "▁")], "doc_id long, text string")
    rows = alignment.align(odd, queries.byte_model(), queries.piece_model()).drop("text").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]
    with pytest.raises(ValueError):
        alignment.align(odd, queries.byte_model(), queries.piece_model(), groups="x")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_intervals_are_overlaps(a, b):
    a, b = (np.cumsum([*x, max(0, sum(y) - sum(x)) or 0] if sum(y) > sum(x) else x) for x, y in ((a, b), (b, a)))
    _, x, y, shared = alignment.intervals(a, b)
    start = lambda e, i: e[i - 1] if i else 0
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(start(a, i), start(b, j)) < min(a[i], b[j])]
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == want and int(shared.sum()) == len(set(a.tolist()) & set(b.tolist()))


def brute_collocations(rows, least, longest, top, inside=80):
    import re

    f, total = Counter(), Counter()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    found = {k: n for k, n in f.items() if len(k) > 2 and n >= least}
    out = defaultdict(list)
    for (lang, *w), a in found.items():
        longer = [n for (m, *v), n in found.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * n >= inside * a for n in longer):
            continue
        cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, all_ in out.items() for i, (s, a, p, x, y) in enumerate(sorted(all_)[:top]))


@pytest.mark.parametrize(("least", "longest", "top", "block_mb"), [(30, 4, 2000, 16), (3, 4, 40, 0), (5, 2, 7, 0), (2, 3, 25, 0)])
def test_collocations_equal_brute_force(docs, least, longest, top, block_mb):
    more = docs.sparkSession.createDataFrame([(None, "x y\x01z A B a b. A b, a  b\tc a b c d a b c d"), (None, "a b c d é É a\x01 b a\x01 b"), ("und", "A B c\x0bd")] * 3, "lang string, text string")
    all_ = docs.unionByName(more, allowMissingColumns=True)
    want = brute_collocations([tuple(r) for r in all_.select("lang", "text").collect()], least, longest, top)
    got = [tuple(r) for r in collocations.collocations(all_, least=least, longest=longest, top=top, block_mb=block_mb).collect()]
    assert sorted(got) == want and len(want) > 20


def test_collocations_equal_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(collocations.sql()).fetchall()
    assert sorted(tuple(r) for r in queries.op13_collocations(spark, small).collect()) == sorted(want) and want


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    odd = spark.createDataFrame([(None, None), ("en", ""), ("en", " . \n"), ("en", "w" * 200_000)], "lang string, text string")
    assert collocations.collocations(odd, least=1).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(odd, longest=5)


def test_radix_runs():
    rng = np.random.default_rng(4)
    hi, lo = rng.integers(0, 1 << 62, 400) >> rng.integers(0, 60, 400), rng.integers(0, 3, 400) << 40
    hi, lo = np.r_[hi, hi[:200]], np.r_[lo, lo[:200]]
    x, y, n = collocations.runs(hi, lo)
    assert list(zip(x.tolist(), y.tolist(), n.tolist(), strict=True)) == sorted((a, b, c) for (a, b), c in Counter(zip(hi.tolist(), lo.tolist(), strict=True)).items())
    assert all(len(v) == 0 for v in collocations.runs(hi[:0], lo[:0]))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_prefixes_of_sorted_keys(longest):
    """Counts by batches of any size and over any cut into partitions, against counting n-grams."""
    import pyarrow as pa

    rng = np.random.default_rng(longest)
    ids = rng.integers(0, 4, 3000)
    want = Counter(tuple(ids[i : i + n]) for n in range(2, longest + 1) for i in range(len(ids) - n + 1) if all(ids[i : i + n]))
    columns = collocations.runs(*collocations.keys_of(ids, longest))
    for size, cuts in ((1, []), (7, [20, 21]), (1000, [1, len(columns[0]) // 2])):
        got, kept = Counter(), 0
        for part in np.split(np.arange(len(columns[0])), cuts):
            batches = [pa.record_batch([pa.array(c[part[i : i + size]]) for c in columns], ["hi", "lo", "n"]) for i in range(0, len(part), size)]
            for b in collocations._prefixes(iter(batches), 50, longest):
                kept += b.num_rows
                for x, y, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got[tuple(v for v in (x >> 32, x & 0xFFFFFFFF, y >> 32, y & 0xFFFFFFFF) if v)] += n
        assert {k: n for k, n in got.items() if n >= 50} == {tuple(map(int, k)): n for k, n in want.items() if n >= 50} and kept < 6 * (len(cuts) + 1) + len(want)
    assert not list(collocations._prefixes(iter([]), 50, longest))
