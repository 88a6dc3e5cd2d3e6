import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared paragraphs, null, empty and long texts."""
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(400)]

    def words(n):
        return [rnd.choice(vocab) for _ in range(n)]

    shared = " ".join(words(60))
    docs = []
    for i in range(60):
        w = words(rnd.choice([3, 40, 80, 200]))
        docs.append("\n".join(" ".join(w[j:j + 40]) for j in range(0, len(w), 40)))
    for i in range(20):  # near copies
        w = docs[i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        docs.append(" ".join(w))
    docs += [docs[3], docs[3], docs[5].upper(), "", None, " \n\t ", "one", "one", "One two", shared + "\n" + docs[7]]
    docs += [" ".join(words(30)) + "\n" + shared + "\n" + " ".join(words(20)) for _ in range(5)]
    docs.append(" ".join(words(20_000)))
    docs.append("ab " * 3000)
    return list(enumerate(docs))
