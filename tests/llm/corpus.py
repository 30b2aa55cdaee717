"""Random corpora with what makes the operators hard: copies, near copies, shared passages, odd texts."""

from __future__ import annotations

import random


def corpus(seed, n=120, vocabulary=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    passage = [rng.choice(vocab) for _ in range(30)]
    base = [rng.choice(vocab) for _ in range(60)]
    texts = [None, "", "  \n\t ", "one", "One two three four", "one two three four", "a\x0bb\x0cc\x1cd\x85e\xa0f g", "日本 語 " * 9, "Ж" * 300]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 20:
            texts.append(rng.choice(texts))
        elif kind < 0.5:
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(" ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
        elif kind < 0.7:
            own = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
            at = rng.randint(0, len(own))
            texts.append(" ".join(own[:at] + passage + own[at:]))
        elif kind < 0.8:
            texts.append("\n".join([" ".join(rng.choice(vocab[:9]) for _ in range(12))] * rng.randint(1, 5)))
        else:
            texts.append(" \n".join(rng.choice(vocab) + rng.choice(["", "#", "|", "."]) for _ in range(rng.randint(1, 200))))
    texts.append(" ".join(rng.choice(vocab) for _ in range(20_000)))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def frame(spark, docs, sources=("a", "b", None)):
    """documents, with columns whose names the operators use inside."""
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), "x", 1, "y") for i, t in docs.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long, host string")
