import math

from trendloom.operators import bayes

ROWS = "doc_id long, text string, label boolean"


def test_weights_by_hand(rows):
    data = [(1, "Good good film", True), (2, "bad film", False), (3, "bad, bad film", False), (4, None, True), (5, "film", None)]
    found = {r.word: r.weight for r in bayes.train_bayes(rows(ROWS, data), label="label", least_texts=1).collect()}
    # Three words of a text labelled yes, five of texts labelled no, three kinds.
    expected = {"good": (3 / 6) / (1 / 8), "film": (2 / 6) / (3 / 8), "bad": (1 / 6) / (4 / 8), "": 2 / 3}
    assert found.keys() == expected.keys() and all(math.isclose(found[w], math.log(x)) for w, x in expected.items())
    assert {r.word for r in bayes.train_bayes(rows(ROWS, data), label="label").collect()} == {"film", ""}


def test_labels_of_texts_held_out(rows):
    data = [(k, f"neural network {'training' if k % 3 else 'weights'}" if k % 2 else f"metal bracket {'screw' if k % 3 else 'housing'}", bool(k % 2)) for k in range(40)]
    model = bayes.train_bayes(rows(ROWS, data), label="label")
    texts = [(1, "a NEURAL net's weights"), (2, "bracket of metal"), (3, None), (4, ""), (5, "unknown words"), (None, "training"), (7, "metal " * 5000)]
    found = {r.doc_id: r for r in bayes.apply_bayes(model, rows("doc_id long, text string", texts)).collect()}
    assert found[1].found and found[1].confidence == "high" and not found[2].found and found[None].found
    assert found[3].log_odds == found[4].log_odds == found[5].log_odds and found[3].confidence == "low"
    assert found[7].log_odds < -5000 and len(found) == len(texts)


def test_nothing_to_learn_from(rows):
    model = bayes.train_bayes(rows(ROWS, [(1, "a b", None)]), label="label")
    assert model.collect() == [] and bayes.apply_bayes(model, rows("doc_id long, text string", [(1, "a")])).collect() == []


def test_frequent_and_other_words_weigh_alike(rows, monkeypatch):
    """Whichever words are weighed where they are read, the odds are the same; an id may have several rows."""
    data = [(k, f"w{k % 5} w{k % 3} w{k % 7} common common", bool(k % 2)) for k in range(60)]
    model = bayes.train_bayes(rows(ROWS, data), label="label")
    texts = rows("doc_id long, text string", [(k % 40, t) for k, t, _ in data] + [(1, "unseen"), (99, None), (None, "w1 w1")])
    found = []
    for share in (1, 8, 1 << 20):
        monkeypatch.setattr(bayes, "FREQUENT", share)
        found.append({r.doc_id: round(r.log_odds, 9) for r in bayes.apply_bayes(model, texts).collect()})
    weight = {r.word: r.weight for r in model.collect()}
    assert found[0] == found[1] == found[2] and found[0][99] == round(weight[""], 9)
    assert found[0][None] == round(weight[""] + 2 * weight["w1"], 9) and len(found[0]) == 42


def test_words_are_summed_before_the_shuffle(rows):
    """Learning groups by word alone, so that its sums combine before the shuffle."""
    many = rows(ROWS, [(k, "a few words only", bool(k % 2)) for k in range(300)])
    model = bayes.train_bayes(many, label="label")
    grouped = [line for line in model._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in line]
    assert grouped and all("hashpartitioning(word#" in line for line in grouped)
