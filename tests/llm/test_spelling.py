import random
import re
import zlib

from pyspark.sql import functions as F

from paperloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = {}
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    nears = {w: [v for v in vocabulary if near(w, v)] for w in vocabulary}
    best = {w: min(vs, key=lambda v: (-vocabulary[v], v)) for w, vs in nears.items() if vs}
    form = {w: v for w, v in best.items() if vocabulary[v] >= 2 * vocabulary[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(nears[w]), vocabulary.get(form.get(w))) for w, n in vocabulary.items()}


def table(seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(150)]
    shares = [1 / (k + 1) for k in range(150)]
    rows = [(i, " ".join(rng.choices(stems, shares, k=rng.randint(0, 80)))) for i in range(60)]
    rows += [(100, "Aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa AAAAAAA aaaaaaaa aaaaaaaa aaaaaaaa " * 4), (101, "ÉCOLES École's éCOLES, Écoles÷x" * 3)]
    rows += [(102, None), (103, ""), (None, "aaaaaa bcbcb bcbcb bcbcb"), (104, "x" * 3000 + " " + ("x" * 3000 + " ") * 3 + ("x" * 2999 + "y ") * 9), (100, "repeated repeated repeated")]
    return rows


def got(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_are_brute_force(docs):
    rows = table()
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 10 and sum(w[4] > 1 for w in want) > 5
    for parts in (1, 9):  # the trie in one piece and cut into parts
        found = spelling.variants(docs(rows, extra=("word", "run", "n", "id", "key")), parts)
        assert got(found) == want and found.count() == len(want)


def test_deleted_code_point_is_that_of_the_checksum(docs):
    rows = [(i, "wordling " * 2 + "Éclairer " * 2) for i in range(600)]
    assert got(spelling.variants(docs(rows))) == brute(rows)
    assert len(brute(rows)) > 2


def test_nodes_of_all_parts_name_the_same_prefixes(spark):
    words = [f"{a}{b}{c}{'z' * d}" for a in "ab" for b in "xyé" for c in "pq" for d in range(4)] + ["b"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for parts in (1, 5, 40):
        name = {}
        for r in spelling.numbered(frame, F.col("word"), "prefixes", parts).collect():
            for d, node in enumerate(r["nodes"]):
                assert name.setdefault(r["word"][:d], node) == node
        assert len(set(name.values())) == len(name) == len({w[:d] for w in words for d in range(len(w) + 1)})


def test_chain_of_forms_ends_at_the_last(docs):
    """Eight words in a row, each twice as frequent as the one before."""
    chain = ["abcdefgh"[:i] + "x" * (8 - i) + "tail" for i in range(9)]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 << k))
    rows = [(None, text)]
    rooted = {r["word"]: r["root"] for r in spelling.variants(docs(rows)).collect()}
    assert rooted == {w: chain[-1] for w in chain}


def test_no_words_give_no_rows(docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None), (2, "a b c")])).count() == 0
