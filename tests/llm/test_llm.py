"""Every operator against a plain version of it, on small tables with the awkward cases."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from brute import jaccard_components, shingle_set
from pyspark.sql import functions as F

from retail_lake.llm import chat, decontaminate, language, mixing, secrets, tokens
from retail_lake.llm.chat import chat_windows, digests
from retail_lake.llm.decontaminate import HammingIndex, benchmark_matches, without_benchmark
from retail_lake.llm.fingerprints import fingerprints_with_edits
from retail_lake.llm.graph import components
from retail_lake.llm.mixing import mix, mixed_documents
from retail_lake.llm.ngram_join import ngram_jaccard_join
from retail_lake.llm.sharding import histogram_shards
from retail_lake.llm.token_counts import token_counts
from retail_lake.llm.token_output import read_token_ids, token_index, write_token_ids
from retail_lake.staging import work_path

SCHEMA = "doc_id long, text string, lang string, source string, key string, shard int, row string"
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 9))) for _ in range(400)]


def text_of(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, step):
    words = text.split(" ")
    return " ".join("changed" if k % step == step - 1 else w for k, w in enumerate(words))


def awkward_rows():
    base = text_of(120, 1)
    line = text_of(60, 2)
    texts = [None, "", "   \n", "one", "One two", "one TWO", base, base, base.upper(), edited(base, 60), edited(base, 9)]
    texts += [f"{line} {text_of(30 + k, 100 + k)}" for k in range(12)]
    texts += [edited(text_of(200, 3), 40 + 7 * k) for k in range(40)]
    texts += [text_of(9000, 4), "x" * 40_000, "é <|endoftext|> 日本語 " * 30, text_of(4, 5), text_of(5, 6)]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, "k", 1, "r") for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, "en", "s0", "k", 1, "r"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, rows, empty):
    found = Counter(tuple(r) for r in ngram_jaccard_join(docs).select("doc_id", "n_shingles", "n_links", "component_id").collect())
    assert found == Counter(jaccard_components([r[:2] for r in rows]))
    assert ngram_jaccard_join(empty).count() == 0


def test_near_duplicates_without_unique_ids(spark):
    base, other, alone = text_of(80, 500), text_of(80, 501), [text_of(60, 510 + k) for k in range(3)]
    texts = [
        (1, base), (None, base), (None, edited(base, 70)), (None, alone[0]), (None, other), (None, other), (None, edited(other, 70)),
        (2, alone[1]), (2, base.upper()), (3, alone[2]), (3, edited(alone[2], 50)), (None, ""), (None, ""), (4, ""), (5, None), (None, None),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit("r"))
    stay = corpus_pipeline.near_duplicates(spark, frame, "")
    assert stay.columns == frame.columns
    found = Counter((r.doc_id, r.text) for r in stay.collect())
    either = [{(None, other), (None, edited(other, 70))}, {(3, alone[2]), (3, edited(alone[2], 50))}]
    for rows_of_one in either:
        assert sum(found.pop(r, 0) for r in rows_of_one) == 1
    assert found == Counter([(1, base), (None, alone[0]), (2, alone[1]), (None, ""), (4, ""), (5, None), (None, None)])


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    parent = {n: n for e in edges for n in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: r for n, r in parent.items() if n in linked}


def plain_base(text):
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(found)]


def test_secret_scan(spark, empty):
    texts = [
        None, "", "é PassWord='abcdefgh12' rest", 'token = "' + "ab12" * 12 + '" x', "secret: short", "AKIA" + "Z9" * 8,
        "AKIAAKIA1", "ſecret=abcdefghij", "api_key=aaaaaaaa apikey : 'bbbbbbbbb'", "authorization header QzR8x1LmW0pTn7VbKd3YfGh5",
        "private key name configuration_configuration", "0123456789abcdef" * 3,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secret_scan(frame).collect():
        spans = plain_base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == spans
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
        assert r.n_novel == (1 if r.doc_id == 9 else 0), r
    assert secrets.secret_scan(empty).count() == 0


def test_secret_scan_of_names_with_values(spark):
    value, letters = "q8ZrT1mXw0Lp7VbKd3YfGh5Nc2Ju", "QzRxbLmWqpTnGvVbKdsYfGhUjCea"
    long_name = "PRIVATE_" + "_".join(["configuration"] * 5)
    jwt = ["eyJhbGciOiJSUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiI0ODE1MTYyMzQyIiwibmFtZSI6Ilh1In0", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVadQssw5c"]
    texts = [
        (f"export AWS_SECRET_ACCESS_KEY={value} done", [value]), (f"PRIVATE_KEY={value}\n", [value]), (f"x SECRET_KEY={value}== y", [value + "=="]),
        (f"https://h.example/a?user=a&signature={value}&page=2", [value]), (f"{long_name}={value}", [value]),
        (f"AWS_SECRET_ACCESS_KEY=\"{value}\"", [value]), (f"'private_key': '{value}'", [value]), (f"private key {letters} end", [letters]),
        (f"PRIVATE_KEY={letters}", [letters]), (f"Authorization: Bearer {'.'.join(jwt)} sent", jwt), ("private key Qz8Rx1LmW0p=Tn7VbKd3YfGh5 x", ["Qz8Rx1LmW0p=Tn7VbKd3YfGh5"]),
        (f"USER_HOME={value}", []), (f"PRIVATE_KEY={'configuration_' * 3}", []), ("private key " + "=" * 40 + " " + "-" * 40, []),
    ]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in secrets.secret_scan(frame).collect():
        text, wanted = texts[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("novel")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == wanted, text


def test_token_files(spark, docs, rows, empty):
    out = write_token_ids(docs, work_path(spark, "t"), parts=3)
    index = sorted((tuple(r) for r in token_index(spark, out).collect()), key=lambda r: r[1])
    tokenizer, start = tokens.load(tokens.WORD_BPE), 0
    assert [r[0] for r in index] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    wanted = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        wanted[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((i, n, c) for i, _, n, c in index) == wanted
    for _, at, n, _ in index:
        assert at == start
        start += n
    assert read_token_ids(spark, out, 3, 5).count() == 3
    assert token_index(spark, write_token_ids(empty, work_path(spark, "t"))).count() == 0


def test_token_counts(docs, rows, empty):
    tokenizer = tokens.load(tokens.BYTE_BPE)
    wanted = Counter()
    for doc_id, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        wanted[doc_id, len((text or "").encode()), n, n > 1024] += 1
    for chunk, overlap in ((1 << 14, 256), (64, 8)):
        found = token_counts(docs, chunk=chunk, overlap=overlap).drop("n_chunks")
        assert Counter(tuple(r) for r in found.collect()) == wanted
    assert token_counts(empty).count() == 0


def test_pieces_encode_as_the_whole():
    parts = ["a", "Word", "l'été", " ", "  ", "\n", " \n", "\t", "\x1c", " ", "́", "Σ", "İ", "12", "'s", "!!", "<|endoftext|>", "<|endof", "日本", "😀", "Größe", "WORD.", " niño,", "Ǆ", "İI.", "ª;", "x" * 300, "été:"]
    for path, split in ((tokens.WORD_BPE, tokens.word_pieces), (tokens.BYTE_BPE, tokens.blank_pieces)):
        tokenizer = tokens.load(path)
        pieces = tokens.Pieces(tokenizer, split)
        assert pieces.pattern is not None
        for k in range(1500):
            rng = random.Random(k)
            text = "".join(rng.choice(parts) * rng.choice([1, 1, 1, 9]) for _ in range(rng.randint(0, 20)))
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert pieces.ids([text])[0].tolist() == ids
            pieces.MOST_BYTES = pieces.words.most_bytes = 2_000 if k % 2 else 1 << 20
            first = "".join(chr(rng.choice([rng.randint(0, 255), rng.choice(b" '\ns.Aa1")])) for _ in range(rng.randint(0, 60)))
            assert pieces.ids([first])[0].tolist() == tokenizer.encode(first, add_special_tokens=False).ids, repr(first)
            if path == tokens.BYTE_BPE:
                assert sum(n for _, _, n in tokens.chunked_spans(pieces, text, 20, 4)) == len(ids)


def test_chat_round_trip(spark):
    marks = [r"\### Assistant: </turn> ok", "", None, "####", "\\", "a\n### x: y</turn>\n", text_of(300, 1), text_of(40, 2), "é" * 50]
    rng, turns = random.Random(5), []
    for conv in range(12):
        first = [(conv, 0, "system", rng.choice(marks))] if conv % 2 else []
        turns += first + [(conv, k + 1, rng.choice(["user", "assistant", "tool:x", None]), rng.choice(marks)) for k in range(conv * 3)]
    turns += [(-7, 0, "user", marks[0]), (-7, 1, "assistant", marks[0]), (None, None, "user", "x"), (-7, 1, "assistant", marks[0])]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat_windows(frame, budget=400, history=100).cache()
    assert windows.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 3
    assert windows.where("n_repeated > 0").count() > 0
    found = {r.conv_id: r for r in digests(windows).collect()}
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(found) == set(by_conv)
    for conv, own in by_conv.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        r = found[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert digests(chat_windows(frame.limit(0))).count() == 0
    assert all(list(chat.parse(chat.format_turn(r, t)[0])) == [(r, t)] for r in ("a:b", "\\", "###") for t in marks if t is not None)


@pytest.mark.parametrize("system", [0, 40, 350, 395, 600])
def test_windows_keep_to_the_budget(spark, system):
    """Also beside a long system turn, and with turns of any size up to more than the budget."""
    rng = random.Random(system)
    turns = [(1, 0, "system", "a " * system)] if system else []
    turns += [(1, k, ("user", "assistant")[k % 2], "a " * rng.choice([1, 9, 30, 60, 150, 330, 450])) for k in range(1, 120)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat_windows(frame, budget=400, history=100).collect()
    pieces = tokens.Pieces(tokens.load(tokens.BYTE_BPE), tokens.blank_pieces)
    size = lambda own: sum(pieces.counts([chat.format_turn(*t)[0] for t in own]))
    repeated = 0
    for w in windows:
        own = list(chat.parse(w.text))
        fewest = [t for k, t in enumerate(own) if k >= w.n_repeated or (k == 0 and system)]
        assert size(own) <= 400 or len(own) <= 1 + bool(system) and size(fewest) > 400
        repeated += w.n_repeated
    assert len(windows) > 20 and (repeated > 20 or system > 390)
    assert sum(len(list(chat.parse(w.text))) - w.n_repeated for w in windows) == len(turns)


def test_language(spark, docs, empty):
    words = {"aa": "the and of wish thing", "bb": "der und von schon dinge", "cc": "это слово другой речи"}
    rows = [(k, " ".join(random.Random(k).choices(words[lang].split(), k=30)), lang) for k in range(90) for lang in [list(words)[k % 3]]]
    rows += [(900, f"{rows[0][1]} {rows[1][1]} {rows[2][1]}", None), (901, None, "aa"), (902, "123 ...", "bb"), (None, "the", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.training_rows(frame))
    found = {r.doc_id: r for r in language.predict(frame, model).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in rows[:90])
    assert [s.lang for s in found[900].spans] == ["aa", "bb", "cc"]
    assert (found[901].lang_pred, found[902].lang_pred, found[902].score) == ("und", "und", 0.0)
    carried = language.predict(docs, model, carry=True)
    assert carried.select("row.*").columns == docs.columns and carried.count() == docs.count()
    assert language.predict(empty, model).count() == 0
    assert language.predict(frame, language.fit(empty)).where("lang_pred = 'und'").count() == len(rows)


def test_viterbi_is_best_path():
    rng = np.random.default_rng(1)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 2, 5, 6, 6)]

    def value(scores, path):
        return sum(scores[k, p] for k, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    import itertools

    for scores, path in zip(texts, language.viterbi(texts, 1.5), strict=True):
        best = max(value(scores, p) for p in itertools.product(range(3), repeat=len(scores)))
        assert value(scores, path) == pytest.approx(best, abs=1e-4)
        one = language.one_label(scores, 1.5)
        assert one < 0 or value(scores, [one] * len(scores)) == pytest.approx(best, abs=1e-4)


def test_fingerprints(docs, rows, empty):
    found = fingerprints_with_edits(docs).collect()
    assert len(found) == len(rows)
    by_text = {}
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is None, -(i or 0)))
    text = {r[0]: r[1] or "" for r in rows}
    for r in found:
        if r.doc_id is None:
            continue
        own, following = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        if ids[(ids.index(r.doc_id) + 1) % len(ids)] is None:
            continue
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        a, b = shingle_set(own.lower()), shingle_set(changed.lower())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)
        assert by_text.setdefault(own, r.fingerprint) == r.fingerprint
    assert fingerprints_with_edits(empty).count() == 0


def test_mixing(docs, rows, empty):
    found = mix(docs, block=16)[0].collect()
    assert sorted(map(str, found)) == sorted(map(str, mix(docs, block=16)[0].collect()))
    sizes = Counter()
    for _, t, _, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [1, 2, 3, 1]), strict=True))
    taken = Counter()
    for r in found:
        assert r._taken <= 3 * r._size
        assert (r._source_size, r._target) == (sizes[r._source], goal[r._source])
        taken[r._source] += r._taken
    assert all(abs(taken[s] - goal[s]) <= 16 + 0.05 * goal[s] for s in order)
    assert mix(empty)[0].count() == 0
    output = mix(docs, block=16)[1].collect()
    for shard in {r.shard for r in output}:  # places have no gaps, and every slot is a run of at most 16 words of one block
        slots = {}
        for r in output:
            if r.shard == shard:
                slots.setdefault(r.place, []).append(r)
        assert sorted(slots) == list(range(len(slots)))
        for own in slots.values():
            ends = sorted((r._begin + r.from_word, r._begin + r.to_word) for r in own)
            assert len({(r.source_number, r.block) for r in own}) == 1 and ends[0][0] % 16 == 0 and ends[-1][1] - ends[0][0] <= 16
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert sum(r.to_word - r.from_word for r in output) == sum(taken.values())
    copies = mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() > 0
    words = Counter()
    for r in copies.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    most = {s: max((len((t or "").split()) for _, t, _, source, *_ in rows if source == s), default=0) for s in order}
    assert all(abs(words[s] - goal[s]) <= most[s] for s in order)
    assert mixed_documents(empty).count() == 0
    assert mixing.targets([10, 10, 100], [3, 1, 1]) == [30.0, 30.0, 60.0]
    image = mixing._permuted(np.arange(1000), 1000, 5)
    assert sorted(image.tolist()) == list(range(1000))


def test_decontamination(spark, docs, empty):
    passage, other = text_of(40, 70), text_of(25, 71)
    bench = spark.createDataFrame([(1, passage), (2, other), (3, None), (4, "one two"), (None, text_of(30, 72))], "item_id long, text string")
    near = edited(passage, 38)
    rows = [(1, f"{text_of(50, 80)}. {passage.title()}! {text_of(9, 81)}"), (2, f"{near} {other}"), (3, text_of(500, 82)), (4, None), (5, ""), (6, "One two"), (7, " ".join(passage.split()[:20]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in benchmark_matches(frame, bench).collect()}
    assert found == {(1, 1), (2, 1), (2, 2), (6, 4)}
    assert sorted(r.doc_id for r in without_benchmark(frame, bench).collect()) == [3, 4, 5, 7]
    assert benchmark_matches(empty, bench).count() == 0
    assert without_benchmark(frame, bench.limit(0)).count() == len(rows)


def plain_similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_decontamination_of_shared_items(spark):
    passage = text_of(100, 90)
    near, far = (" ".join("changed" if k in at else w for k, w in enumerate(passage.split())) for at in ((50,), (20, 70)))
    held = {"near": (plain_similarity(passage, near), near), "far": (plain_similarity(passage, far), far)}
    assert 0.75 <= held["far"][0] < held["near"][0] == pytest.approx(91 / 101)
    frame = spark.createDataFrame([(k, f"{text_of(30, 91)} {t} {text_of(30, 92)}") for k, (_, t) in enumerate(held.values())], "doc_id long, text string")
    items = {
        "one": [(1, passage)], "rows": [(1, passage)] * 10, "ids": [(k, passage) for k in range(2)], "many": [(k, passage) for k in range(10)],
        "template": [(k, f"{passage} {text_of(6, 200 + k)}") for k in range(10)],
    }
    for name, bench in items.items():
        found = benchmark_matches(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()
        if name == "template":
            assert {r.item_id for r in found if r.doc_id == 0} == set(range(10))
            continue
        assert len(found) == 2 * len({i for i, _ in bench})
        for r in found:
            assert r.similarity == pytest.approx(list(held.values())[r.doc_id][0])


def test_decontamination_in_passes(spark, monkeypatch):
    passages = [text_of(60, 300 + k) for k in range(3)]
    items = [(1, passages[0]), (2, passages[0]), (1, passages[1]), (1, edited(passages[0], 40)), (3, passages[1]), (None, passages[1])]
    items += [(None, passages[2]), (4, f"{passages[0]} {text_of(4, 310)}"), (5, "one two"), (5, "one two"), (6, None), (7, text_of(40, 311))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    both = f"{text_of(20, 320)} {edited(passages[0], 50)} {passages[1]} {passages[2]}"
    texts = [(1, both), (1, both), (1, passages[1]), (None, both), (None, both), (2, "One two"), (3, text_of(80, 321)), (4, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit(1))
    found, clean = [], []
    for at_once in (2, 20_000):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
        found.append(Counter(tuple(r) for r in benchmark_matches(frame, bench).collect()))
        clean.append(Counter(tuple(r) for r in without_benchmark(frame, bench).collect()))
    assert found[0] == found[1] and clean[0] == clean[1]
    assert Counter((d, i) for d, i, *_ in found[0].elements())[1, 1] == 3
    assert sorted(d for d, *_ in clean[0]) == [3, 4]


def test_hamming_index_misses_nothing():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = HammingIndex(prints, 20)
    for one in [int(prints[5]) ^ 0b1011, *rng.integers(0, 1 << 63, 30, dtype=np.uint64).tolist()]:
        wanted = [k for k, p in enumerate(prints.tolist()) if (p ^ one).bit_count() <= 20]
        assert index.within(one).tolist() == wanted


def test_decontamination_of_copies_of_another_size(spark):
    item = text_of(100, 400).split()
    copies = [
        item[:50] + text_of(10, 401).split() + item[50:], item[:30] + ["put"] * 3 + item[30:60] + text_of(6, 402).split() + item[60:],
        item[:40] + item[52:], item[:85], item[12:], item[5:50] + ["put", "in"] + item[50:96], item,
    ]
    texts = [f"{text_of(17, 410)} {' '.join(c)} {text_of(23, 411)}" for c in copies]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.similarity, r.start_word) for r in benchmark_matches(frame, bench).collect()}
    assert found[0][0] == pytest.approx(92 / 110)
    own = shingle_set(" ".join(item))
    for k, text in enumerate(texts):
        words, best = text.split(), (0.0, 0)
        held = [tuple(words[a : a + 5]) for a in range(len(words) - 4)]
        for a in range(len(held)):
            window = set()
            for shingle in held[a:]:
                window.add(shingle)
                best = max(best, (len(window & own) / len(window | own), -a))
        assert best[0] >= 0.75 and found[k] == (pytest.approx(best[0]), -best[1])


def test_sharding(spark, docs, rows, empty):
    many = docs.unionAll(spark.createDataFrame([(1000 + k, "same text", None, None, None, None, None) for k in range(500)], SCHEMA))
    found = histogram_shards(many, shards=4).collect()
    assert len(found) == len(rows) + 500
    total, sizes, slots = sum(r.size for r in found), Counter(), {}
    for r in found:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    largest = max(r.size for r in found)
    assert all(abs(sizes[s] - total / 4) <= largest for s in range(4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in found if r.doc_id is not None and r.doc_id in texts)
    assert histogram_shards(empty).count() == 0


def test_workers_need_not_have_the_package(tmp_path):
    """The driver alone can import it: another working folder, no PYTHONPATH."""
    repo = str(Path(corpus_pipeline.__file__).parent)
    code = f"""
import sys; sys.path.append({repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from retail_lake.llm.ngram_join import ngram_jaccard_join
from retail_lake.llm.repair import repair_report
from retail_lake.llm.spelling import spelling_variants
docs = spark.createDataFrame([(k, "one two three four five six seven" + " x" * (k // 2)) for k in range(8)], "doc_id long, text string")
print("ROWS", ngram_jaccard_join(docs).count(), spelling_variants(docs, 3, 1).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 8 " in done.stdout, done.stderr[-2000:]


def test_stages_on_awkward_documents(spark, docs, rows):
    """Every stage that hands on documents keeps their columns, whatever these are called."""
    odd = docs.withColumns({"kept_text": F.lit("k"), "own_text": F.lit("o"), "odd name: x": F.lit(1), "_copies": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (odd, odd.limit(0)):
            kept = stage(spark, frame, "/root/testdata/sf0.001")
            assert kept.columns == odd.columns, name
            found = kept.select("kept_text", "own_text", "`odd name: x`", "_copies").distinct().collect()
            assert found == [("k", "o", 1, 2)] or (not found and frame is not odd), name
    index = corpus_pipeline.token_files(spark, odd, "")
    assert index.count() == len(rows)


def test_pipeline_run(spark):
    sf = "/root/testdata/sf0.001"
    index = corpus_pipeline.run(spark, sf).collect()
    starts = sorted((r.start, r.n_tokens) for r in index)
    assert len(index) > 50 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in index} <= ids
