import random

from tapewright.llm.toxicity import Lexicon, Scorer, _beginnings, _terms, accepted, fit, score, toxicity

from .conftest import PROSE, documents

TERMS = [("moron", True, 1.0), ("idiot", False, 1.0), ("scum", True, 0.8)]


def edits(a, b):
    """Distance with swaps of neighbours, by the full table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_finds_what_the_table_finds():
    lexicon = Lexicon([(t, True, 1.0) for t in ("moron", "scumbag", "loser", "wretch", "blockhead")])
    for term in lexicon.weight:
        words = [term, *(term[:i] + c + term[i + k :] for i in range(1, len(term)) for k in (0, 1) for c in ("", "x", "o")), *(term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(1, len(term) - 1))]
        for w in words:
            for most in (1, 2):
                near = [t for t in lexicon.weight if t[0] == w[0] and edits(t, w) <= most and len(t) > 3 * edits(t, w)]
                found = lexicon.within([w], most)[0]
                assert bool(found) == bool(near) and (not found or edits(found, w) == min(edits(t, w) for t in near))


def nearest_by_table(terms, word, most):
    """What ``Lexicon.within`` says it finds, by the full table of each term."""
    found = []
    for term, whole, _ in terms:
        ends = range(len(word) + 1) if not whole else [len(word)]
        if not whole and len(term) < 9:
            ends = [j for j in ends if j and (word[j - 1] == term[-1] or j > 1 and word[j - 2] == term[-1] and word[j - 1] == term[-2])]
        d = min((edits(term, word[:j]) for j in ends), default=99)
        if d <= most and len(term) > (3 if whole else 4) * d and (term[0] == word[0] or len(term) >= 9 and len(word) >= 8):
            found.append((d, term))
    return min(found)[1] if found else ""


def test_trie_and_automaton_equal_the_tables_of_all_terms():
    rng = random.Random(5)
    for letters in ("ab", "abcdef"):
        made = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 13))): rng.random() < 0.5 for _ in range(40)}
        terms = [(t, whole, 1.0) for t, whole in made.items()]
        words = []
        for _ in range(150):
            w = [*rng.choice(terms)[0], *(rng.choice(letters) for _ in range(rng.randint(0, 4)))]
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(letters)], [w[i], rng.choice(letters)]]) if len(w) > 1 else [w[i]]
            words.append("".join(w))
        words.append("ab" * 200)
        for most in (1, 2):
            assert Lexicon(terms).within(words, most) == [nearest_by_table(terms, w, most) for w in words]


def test_hits_by_kind():
    scorer = Scorer(Lexicon(TERMS, {"motor"}))
    kinds = lambda text: scorer.evidence(text)[1:]
    assert kinds("you moron !") == (1, 0, 0)
    assert kinds("What IDIOTIC nonsense") == (1, 0, 0)
    assert kinds("you m0ron and moorn") == (0, 2, 0)
    assert kinds('he said "you moron" and left') == (0, 0, 1)
    assert kinds("a motor runs; " + PROSE) == kinds("") == kinds(None) == (0, 0, 0)
    assert scorer.evidence("you moron")[0] > scorer.evidence("you m0ron")[0] > 0
    assert scorer.evidence("you moron")[0] > scorer.evidence('she wrote: "you moron"')[0] > 0


def test_a_small_memory_changes_nothing():
    text = "you moron and idiots, scumm " + PROSE
    assert Scorer(Lexicon(TERMS), kept=2).evidence(text) == Scorer(Lexicon(TERMS)).evidence(text)


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 500 and right >= 0.97 * len(rows)
    low, high = ([r.score for r in rows if r.toxic == t] for t in (0, 1))
    better = sum((a < b) + 0.5 * (a == b) for a in low for b in high)
    assert better >= 0.95 * len(low) * len(high)


def test_support_does_not_grow_with_the_table():
    for n in (400, 4000):
        toxic = {"rare\0": 8, "vile\0": n // 2, "odd\0": 4}
        assert {x for x, _, _ in _terms(toxic, {}, n, 8 * n)} == {"rare", "vile"}
    assert _terms({"mixed\0": 8}, {"mixed\0": 3}, 400, 3200) == []


def test_scripts_without_spaces_and_short_words(spark):
    assert {"傻逼", "逼了"} <= _beginnings("你是傻逼了") and {"un\0"} <= _beginnings("un café") and "a" * 12 in _beginnings("a" * 40)
    rows = [(i, ("他说你真是傻逼啊" if i % 8 == 0 else "今天天气很好我们去") + chr(0x4E00 + i) + "。") for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int(i % 8 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    out = toxicity(documents(spark, rows), labels).collect()
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in out)


def test_edits_of_beginnings_signs_and_first_letters():
    scorer = Scorer(Lexicon([("idiot", False, 1.0), ("stupid", True, 1.0), ("disgusting", True, 1.0), ("blockhead", False, 1.0)]))
    kinds = lambda text: scorer.evidence(text)[1:]
    for word in ("idoits", "idoitic", "$tupid", "$tupd", "blokcheads", "disgustign", "tisgusting", "isgusting", "xdisgusting", "idsgusting", "vlockheads", "lockheads"):
        assert kinds(f"you {word} !") == (0, 1, 0), word
    assert kinds("@stupid, @idiots") == (2, 0, 0)
    assert kinds("idea ideal $1000 1500 studio headblock @") == (0, 0, 0)


def test_messy_rows(spark, messy, messy_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity(messy, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(d) for d, _ in messy_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert not any(r.held_out for r in out if r.doc_id is None)
    assert toxicity(empty, labels).collect() == [] and toxicity(messy, labels.limit(0)).count() == len(messy_rows)


def test_other_columns_stay(spark):
    rows = [(i, f"you idiot {w}" if i % 2 else f"dear {w}") for i, w in enumerate(PROSE.split() * 4)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    kept = accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in rows if i % 2 == 0]
    assert {r.score for r in kept.select("score").collect()} == {"x"}
    assert len(set(score(docs, model).columns)) == len(score(docs, model).columns)


def test_quotations_are_told_by_the_nearest_marks():
    from tapewright.llm.toxicity import Scorer

    of = lambda text: Scorer._quoted(text.split(" "), text.split(" ").index("idiot"))
    assert of('he said "you are an idiot today" loudly') and of('the "you idiot now" thing')
    assert not of('He "waved" then idiot and "bye"') and not of("you idiot")
