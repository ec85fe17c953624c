import random

import corpus_pipeline
from tests.llm import brute


def lines(seed=9):
    """Documents of a few lines, some of over 50 words and shared by documents that are otherwise different."""
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(n))
    shared = [words(n) for n in (49, 50, 60, 25, 25, 24)]
    texts = [shared[2], f"{words(9)}\n{shared[2]}\n{words(9)}", f"{shared[3]}\n{shared[4]}", f"x\n\n{shared[3]}\n\n{shared[4]}\ny", f"{shared[4]}\n{shared[5]}", f"z\n{shared[4]}\n{shared[5]}", None, "", f"{shared[2]}\n{shared[2]}"]
    texts += ["\n".join(r.choice([*shared, words(3), "same"]) for _ in range(r.randint(0, 6))) for _ in range(60)]
    return dict(enumerate(texts))


def removed(docs):
    seen, gone = set(), {}
    held = {i: [x for x in (t or "").split("\n") if brute.WORD.search(x.encode())] for i, t in docs.items()}
    for i in sorted(held):
        gone[i] = set()
        for width in (1, 2, 3):
            for k in range(len(held[i]) - width + 1):
                run = tuple(held[i][k : k + width])
                if width == 3 or sum(len(x.split()) for x in run) >= 50:
                    if run in seen:
                        gone[i] |= set(range(k, k + width))
                    seen.add(run)
    return {i: [x for k, x in enumerate(held[i]) if k not in gone[i]] for i in held}


def test_stage_removes_later_passages_on_one_or_two_lines(spark):
    docs = lines()
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: [x for x in (r.text or "").split("\n") if x.strip()] for r in corpus_pipeline.repeated_lines_out(spark, rows, "").collect()}
    assert found == removed(docs)
    assert len(found[1]) == 2 and found[3] == ["x", "y"] and len(found[5]) == 3
