"""Simplification operators on inline rows: get-or-compute, models, batches, generators."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from lisible.operators import simplify as sp


def test_pending_simplifications_rules(spark):
    stored = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "article_id long, simplification_id long")
    req = spark.createDataFrame([(1, 1, "m1", 0), (1, 3, "m1", 1), (2, 2, "m2", 2), (3, 0, "m3", 3), (2, -1, "m2", 4)],
                                "article_id long, n long, resolved_model string, seq long")
    got = sorted(tuple(r) for r in sp.pending_simplifications(req, stored, F.lit("dflt")).collect())
    # article 1: hit for n=1, n=3 needs 2 and 3; article 2: n=2 needs 1, 2; article 3: n=0 needs 0; negative n rejected
    assert got == [(1, 2, "m1"), (1, 3, "dflt"), (2, 1, "m2"), (2, 2, "dflt"), (3, 0, "m3")]


def _sequential(requests, counts, default):
    """The rules one request after the other."""
    stored, made = dict(counts), []
    for article, n, model, _ in sorted(requests, key=lambda r: r[3]):
        first = True
        while n is not None and n >= 0 and stored.get(article, 0) <= n:
            made.append((article, stored.get(article, 0), model if first else default))
            stored[article] = stored.get(article, 0) + 1
            first = False
    return sorted(made)


def test_pending_requests_are_served_in_order_of_arrival(spark):
    import random
    rng = random.Random(4)
    req = [(rng.randrange(8), rng.choice([-1, 0, 1, 2, 3, 4]), rng.choice(["x", "y", "z"]), i) for i in range(60)]
    req += [(20, 0, "x", 100), (20, 1, "y", 101), (21, 0, "z", 102), (21, 0, "a", 103)]
    counts = {0: 2, 3: 1, 5: 5}
    schema = "article_id long, n long, resolved_model string, seq long"
    stored = spark.createDataFrame([(a, i) for a, n in counts.items() for i in range(n)], "article_id long, simplification_id long")
    got = sp.pending_simplifications(spark.createDataFrame(req, schema), stored, F.lit("dflt")).collect()
    assert sorted(tuple(r) for r in got) == _sequential(req, counts, "dflt")


def test_versions_are_made_by_their_model(spark):
    from lisible.constants import LEVELS
    arts = spark.createDataFrame([(0, "t", "Un chat (noir) dort ; il ronfle. Fin.")], "article_id long, title string, text string")
    todo = spark.createDataFrame([(0, 0, "rule-rewrite:v1"), (0, 1, "rule-rewrite-keep:v1"), (0, 2, "echo"), (0, 3, "nobody")],
                                 "article_id long, simplification_id long, model string")
    echo = sp.PandasGenerator(lambda: None, lambda m, chats: [c.split('"""')[1].upper() for c in chats])
    out = sp.simplify_and_rescore(todo, arts, implementations={**sp.IMPLEMENTATIONS, "echo": echo})
    got = {r["simplification_id"]: r["text"] for r in out.collect()}
    assert got == {0: "Un chat dort Fin.", 1: "Un chat dort ; il ronfle. Fin.", 2: "UN CHAT (NOIR) DORT ; IL RONFLE. FIN."}
    assert set(LEVELS) < set(out.columns)


def test_one_bad_row_fails_alone_with_its_whole_message(spark):
    message = "no answer " * 60

    def gen(model, chats):
        if any("mauvaise" in c for c in chats):
            raise ValueError(message)
        return ["ok"] * len(chats)

    sents = spark.createDataFrame([(0, i, "Phrase mauvaise." if i == 3 else f"Phrase {i}.") for i in range(8)], "article_id long, pos int, sentence string")
    prompts = sp.simplification_prompts(sp.sentence_levels(sents.coalesce(1)))
    got = {r["pos"]: r for r in sp.PandasGenerator(lambda: 1, gen).generate(prompts).collect()}
    assert [got[i]["status"] for i in range(8)] == ["ok"] * 3 + ["error"] + ["ok"] * 4
    assert got[3]["error"] == message and got[3]["prediction"] == "Phrase mauvaise."


def test_resolve_model(spark):
    reg = sp.generator_registry(spark)
    req = spark.createDataFrame([(1, None), (2, "rule-rewrite-keep"), (3, "nope")], "article_id long, model string")
    got = {r["article_id"]: (r["resolved_model"], r["model_status"]) for r in sp.resolve_model(req, reg).collect()}
    assert got == {1: ("rule-rewrite:v1", "ok"), 2: ("rule-rewrite-keep:v1", "ok"), 3: (None, "unknown_model")}


def test_registry_from_json_folder(spark):
    d = tempfile.mkdtemp(prefix="lisible-reg-")
    docs = {"a.json": ("base-x", "ft-x-old"), "b.json": ("base-y", "ft-y"), "c.json": ("base-x", "ft-x-new")}
    for name, (m, ft) in docs.items():
        with open(os.path.join(d, name), "w") as fh:
            json.dump({"model": {"model": m, "fine_tuned_model": ft, "created_at": 1, "hyperparameters": {"n_epochs": 3}},
                       "file": {"bytes": 10}}, fh, indent=2)
    reg = {r["model"]: r["fine_tuned_model"] for r in sp.generator_registry(spark, d).collect()}
    assert reg == {"base-x": "ft-x-new", "base-y": "ft-y"}


def test_rule_generator_and_reassembly(spark):
    docs = spark.createDataFrame([(1, "Il part (vite) ; il revient. Bonjour : oui."), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["simplified"] for r in sp.simplify_documents(docs).collect()}
    assert got == {1: "Il part Bonjour", 2: ""}


def test_model_generator_path_matches_native(spark):
    docs = spark.createDataFrame([(1, "Un deux (trois). Quatre ; cinq."), (2, "Six.")], "doc_id long, text string")

    def load():
        return "model"

    def gen(model, chats):
        return [c.split('"""')[1] for c in chats]   # echo the quoted sentence back

    echo = sp.PandasGenerator(load, gen)
    got = {r["doc_id"]: r["simplified"] for r in sp.simplify_documents(docs, generator=echo).collect()}
    assert got == {1: "Un deux (trois). Quatre ; cinq.", 2: "Six."}


def test_file_exchange_generator(spark):
    d = tempfile.mkdtemp(prefix="lisible-gen-")
    prompts = sp.simplification_prompts(sp.sentence_levels(
        spark.createDataFrame([(1, 0, "Phrase un."), (1, 1, "Phrase deux.")], "doc_id long, pos int, sentence string")))
    g = sp.FileExchangeGenerator(f"{d}/req", f"{d}/resp")
    g.write_requests(prompts)
    assert spark.read.json(f"{d}/req").count() == 2
    with open(f"{d}/resp.json", "w") as fh:
        fh.write(json.dumps({"doc_id": 1, "pos": 0, "prediction": " Une phrase. "}) + "\n")
    g = sp.FileExchangeGenerator(f"{d}/req", f"{d}/resp.json")
    got = {r["pos"]: (r["prediction"], r["status"]) for r in g.generate(prompts).collect()}
    assert got == {0: ("Une phrase.", "ok"), 1: ("Phrase deux.", "pending")}


def test_generation_batches_padding(spark):
    enc = spark.createDataFrame([(1, i, list(range(1, 2 + i % 5))) for i in range(20)], "doc_id long, pos int, ids array<bigint>")
    rows = sp.generation_batches(enc, batch_size=4).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r["batch_id"], []).append(r)
    for batch in by_batch.values():
        assert len(batch) <= 4
        width = max(r["n_ids"] for r in batch)
        for r in batch:
            assert len(r["input_ids"]) == width == r["batch_len"]
            assert r["input_ids"][width - r["n_ids"]:] == list(range(1, 1 + r["n_ids"]))
            assert r["attention_mask"] == [0] * (width - r["n_ids"]) + [1] * r["n_ids"]
            assert r["max_length"] == max(128, 2 * width)


def test_render_chat_pieces(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 5, "user", "c")],
                                  "conv_id long, turn long, role string, text string")
    pieces = {(r["conv_id"], r["turn"]): r["piece"] for r in sp.render_chat(turns).collect()}
    assert pieces[(1, 0)] == "<s><|user|>\na</s>\n"
    assert pieces[(1, 1)] == "<|assistant|>\nb</s>\n<|assistant|>\n"
    assert pieces[(2, 5)] == "<s><|user|>\nc</s>\n<|assistant|>\n"


def test_generation_batches_global_padding(spark):
    enc = spark.createDataFrame([(1, i, list(range(1, 2 + i % 5))) for i in range(10)], "doc_id long, pos int, ids array<bigint>")
    rows = sp.generation_batches(enc, batch_size=4, pad_to="global").collect()
    assert {len(r["input_ids"]) for r in rows} == {5}


def test_compat_predictions(spark):
    g = spark.createDataFrame([("a", "ok"), ("b", "error")], "prediction string, status string")
    assert [r["prediction"] for r in sp.compat_predictions(g).collect()] == ["a", "Error"]


def test_keep_paragraphs(spark):
    docs = spark.createDataFrame([(1, "Un (a). Deux ; trois.\n\nQuatre.\n\n\n")], "doc_id long, text string")
    assert sp.simplify_documents(docs, keep_paragraphs=True).first()["simplified"] == "Un . Deux\n\nQuatre."
    assert sp.simplify_documents(docs).first()["simplified"] == "Un . Deux Quatre."


def test_simplify_rounds_from_previous(spark):
    arts = spark.createDataFrame([(0, "A (b) c ; d. E : f.")], "article_id long, text string")
    got = {r["simplification_id"]: r["text"] for r in sp.simplify_rounds(arts, 2).collect()}
    assert got == {0: "A c E", 1: "A c E"}


def test_pandas_model_scorer(spark):
    import numpy as np
    from lisible.constants import LEVELS
    from lisible.operators.scoring import PandasModelScorer

    def load():
        return np.linspace(0.5, 3.0, 6)

    def predict(weights, sentences):
        lengths = np.array([len(s) for s in sentences], dtype=float)[:, None]
        logits = -np.abs(lengths / 10.0 - weights[None, :])
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    df = spark.createDataFrame([(1, "Court."), (2, "Une phrase nettement plus longue que la premiere.")],
                               "id long, sentence string")
    rows = PandasModelScorer(load, predict).score(df).collect()
    assert len(rows) == 2
    for r in rows:
        assert abs(sum(r[lv] for lv in LEVELS) - 1.0) < 1e-9


def test_conversations_as_one_string(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, None, None), (2, 1, "tool", "x"), (3, 1, "system", "")]
    got = {r["conv_id"]: (r["n_turns"], r["formatted_chat"]) for r in sp.render_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    end = sp.GENERATION_PROMPT
    assert got == {1: (3, "<s><|user|>\na</s>\n<|assistant|>\nb</s>\n<|user|>\n</s>\n" + end), 2: (1, "<s><|tool|>\nx</s>\n" + end),
                   3: (1, "<s><|system|>\n</s>\n" + end)}
