"""Token alignment against a plain version that walks the byte offsets."""

import hashlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rulesieve.llm import alignment
from tests.llm.conftest import DOCS, plain

PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def encode():
    first, second = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(PATHS[1])
    first.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}

    def of(text):
        if not text:
            return None
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        pieces = [second.id_to_piece(i) for i in b]
        bytes_b = [
            bytes.fromhex(p[3:5]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)
        ]
        whole = b" " + text.encode()
        return (a, b, bytes_a, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None

    return of


def groups_of(encoded):
    """Lists of ids of A and B between the offsets where both end."""
    a, b, bytes_a, bytes_b = encoded
    out, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a == end_b and out[-1][0]:
            out.append(([], []))
        if end_a <= end_b and i < len(a) and (end_a < end_b or not out[-1][0]):
            out[-1][0].append(a[i])
            end_a += len(bytes_a[i])
            i += 1
        else:
            out[-1][1].append(b[j])
            end_b += len(bytes_b[j])
            j += 1
    return out


def expected(rows, encode):
    encoded = [encode(text) for text in (r[1] for r in rows)]
    groups = [groups_of(e) if e else [] for e in encoded]
    links = [Counter(pair for g in of for pair in product(*g)) for of in groups]
    count = Counter(pair for of in links for pair in of)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for row, e, of, found in zip(rows, encoded, groups, links):
        printed = ";".join("|".join(",".join(map(str, side)) for side in g) for g in of)
        out.append((
            row[0], len(e[0]) if e else 0, len(e[1]) if e else 0, len(of), sum(found.values()), printed,
            sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()),
        ))
    return out


def listed(df):
    columns = "doc_id n_a n_b n_groups n_links groups n_best count_sum".split()
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


AWKWARD = ["<s> </s> <|endoftext|> <0x41>", "a▁b", "\x00 null", "  two  blanks ", "ｗｉｄｅ ﬁ", "́é", "\r\n\ttabs\x85", "123456789012345678901234567890", "日本語日本語 日本" * 30]


def test_equals_brute_force(spark, rows, encode):
    more = rows + [(1000 + i, t, None, None, None) for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(more, DOCS).repartition(3)
    assert listed(alignment.aligned(docs, *PATHS)) == sorted(map(repr, expected(more, encode)))


def test_digest_is_the_hash_of_the_groups(spark, docs):
    whole = {(r.doc_id, r.n_a): r.groups for r in alignment.aligned(docs, *PATHS[:2]).collect()}
    for r in alignment.aligned(docs, *PATHS, digest=True).collect():
        text = whole[r.doc_id, r.n_a]
        assert r.groups == (hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_small_blocks_give_the_same(spark, docs, monkeypatch):
    whole = plain(alignment.aligned(docs, *PATHS))
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 50)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    monkeypatch.setattr(alignment, "SLICE_LINKS", 7)
    monkeypatch.setattr(alignment, "PLAIN_LINKS", 1)
    assert plain(alignment.aligned(docs, *PATHS)) == whole


def test_empty_table_and_clashing_names(spark, docs, no_docs, clashing):
    assert alignment.aligned(no_docs, *PATHS).count() == 0
    assert plain(alignment.aligned(clashing(docs), *PATHS)) == plain(alignment.aligned(docs, *PATHS))
    nothing = docs.where("text is null")
    assert all(r.n_a == r.n_links == r.count_sum == 0 and r.groups == "" for r in alignment.aligned(nothing, *PATHS).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1), st.lists(st.integers(1, 6), min_size=1))
def test_terminals_label_components(a, b):
    a, b = list(a), list(b)
    (a if sum(a) < sum(b) else b).append(abs(sum(a) - sum(b)) or 1)
    if sum(a) != sum(b):
        (a if sum(a) < sum(b) else b).append(1)
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    ends = np.concatenate([ends_a, ends_b])
    cuts = sorted(set(ends_a) & set(ends_b))
    label = alignment.terminals(ends_a, ends_b)
    assert [cuts.index(ends[t]) for t in label] == [next(i for i, c in enumerate(cuts) if e <= c) for e in ends]
