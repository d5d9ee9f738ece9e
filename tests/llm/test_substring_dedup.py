import random

import brute
import pytest

from topiclens.llm.substring_dedup import SuffixAutomaton, substring_dedup


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=str)


@pytest.mark.parametrize("crowded", [1, 4096])
def test_against_all_windows(spark, crowded):
    """Shared passages around the threshold, small alphabets, repeats within a text."""
    draw = random.Random(7)
    word = lambda n=40: "w%d" % draw.randrange(n)
    passages = [[word() for _ in range(n)] for n in (11, 12, 13, 20, 40)] + [["a"] * 30, ["a", "b"] * 15]
    docs = []
    for d in range(80):
        own = [word(6 if d % 9 == 0 else 400) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(own) + 1)
            own[at:at] = draw.choice(passages)
        docs.append((d, draw.choice([" ", "  ", "\n", "  "]).join(own)))
    docs += [(200, docs[5][1]), (201, docs[5][1]), (202, "é " * 50)]
    got = rows(substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), window=12, gram=5, crowded=crowded))
    want = sorted(((d, *r) for (d, _), r in zip(docs, brute.without_repeats([t for _, t in docs], 12))), key=str)
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    every = odd_docs.collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(every, brute.without_repeats([r.text for r in every], 35))), key=str)
    assert rows(substring_dedup(odd_docs)) == want
    assert substring_dedup(no_docs).collect() == []


def test_automaton_counts_places():
    draw = random.Random(1)
    for _ in range(200):
        texts = [([draw.choice("ab") for _ in range(draw.randint(0, 12))], draw.randint(1, 3)) for _ in range(4)]
        automaton, n = SuffixAutomaton(), 3
        for t, weight in texts:
            automaton.add(t, weight, n - 1)
        automaton.total()
        for t, _ in texts:
            found = dict(automaton.statistics(t, n))
            for end in range(n - 1, len(t)):
                run = t[end - n + 1 : end + 1]
                assert found[end] == sum(w for o, w in texts for i in range(len(o) - n + 1) if o[i : i + n] == run)
