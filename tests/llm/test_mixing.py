"""The pipeline's mix: blocks of words in the slots that were drawn for them."""

import corpus_pipeline
from retail_lake.llm.mixing import BLOCK_WORDS, mix

DOC = "doc_id long, text string, source string, shard string"


def test_source_mix_puts_blocks_into_slots(spark):
    sizes = {"a": [700, 3, 129, 128], "b": [2000, 5], None: [40, 300]}
    rows = []
    for source, many in sizes.items():
        for n in many:
            text = "\n  " * (n % 2) + " \t".join(f"w{len(rows)}x{k}" for k in range(n)) + " " * (n % 3)
            rows.append((len(rows), text, source, f"s{len(rows)}"))
    rows += [(90, None, "a", "x"), (91, " \n", "b", "y"), (None, "one two", "a", "null id"), rows[2]]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    found = corpus_pipeline.source_mix(spark, docs, "").collect()
    plain, output = mix(docs)
    taken = sum(r._taken for r in plain.collect())
    assert taken > 0 and sum(len(r.text.split()) for r in found) == taken and len(found) == output.count()
    texts = {r[0]: r[1] for r in rows}
    slots, cuts = {}, {}
    for r in found:
        words = r.text.split()
        assert texts[r.doc_id].split()[r.from_word : r.from_word + len(words)] == words
        assert r["shard"] == {x[0]: x[3] for x in rows}[r.doc_id]
        slots.setdefault((r["shard_"], r.place), []).append(len(words))
        cuts.setdefault(r.doc_id, {})[r.from_word] = r.text
    assert max(map(sum, slots.values())) == BLOCK_WORDS
    for shard in {s for s, _ in slots}:
        assert sorted(p for s, p in slots if s == shard) == list(range(sum(s == shard for s, _ in slots)))
    # joined, the parts of a document are its text; a row that stands twice is cut in two ways
    for doc in (4, 6, 7, 3):
        if sum(len(t.split()) for t in cuts[doc].values()) == len(texts[doc].split()):
            assert "".join(t for _, t in sorted(cuts[doc].items())) == texts[doc]
    assert 90 not in cuts and 91 not in cuts
    assert any("".join(t for _, t in sorted(c.items())) == texts[d] and len(c) > 1 for d, c in cuts.items())
