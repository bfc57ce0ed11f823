"""The pipeline's stages against plain versions written apart from the operators, each on its own input, and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import plain_raking
from twintree.llm.queries import tokenizer_model
from twintree.llm.toxicity import features_of, fit_toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_components(rows: list) -> set[int]:
    """The smallest ids of documents linked by five-word shingles at 0.8 or more."""
    sets = {}
    for r in rows:
        words = "".join(c.lower() if c.isascii() else c for c in r["text"] or "")
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", words) if w]
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids, root = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i for i in ids if root[i] == i}


def plain_topic(text: str | None) -> str:
    if not text:
        return "empty"
    if re.search(r"\blicen[sc]e", text, re.IGNORECASE | re.ASCII):
        return "legal"
    if re.search(r"(?m)^[^|\n]*\|[^|\n]*\|", text):
        return "table"
    if sum(c in "%$&*#!|" for c in text) / len(text) > 0.05:
        return "noise"
    return "note" if len(text) < 600 else "article" if len(text) < 4000 else "long"


def plain_mixture(rows: list) -> set[int]:
    words = [len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or "")) for r in rows]
    labels = [(r["source"], r["lang"], plain_topic(r["text"])) for r in rows]
    cells = sorted(set(labels))
    tokens = [float(sum(w for w, x in zip(words, labels, strict=True) if x == c)) for c in cells]
    codes, targets = [], []
    for k in range(3):
        values = sorted({c[k] for c in cells})
        codes.append([values.index(c[k]) for c in cells])
        present = [sum(t for t, c in zip(tokens, cells, strict=True) if c[k] == v) for v in values]
        share = [p**0.7 for p in present]
        budget, full = 0.7 * sum(tokens), [False] * len(values)
        while True:  # what is over what is present goes to the others
            free = sum(s for s, f in zip(share, full, strict=True) if not f)
            left = budget - sum(p for p, f in zip(present, full, strict=True) if f)
            wanted = [p if f else s * left / free for p, s, f in zip(present, share, full, strict=True)]
            over = [i for i, f in enumerate(full) if not f and wanted[i] > present[i]]
            if not over:
                break
            for i in over:
                full[i] = True
        targets.append(wanted)
    chance = dict(zip(cells, plain_raking(tokens, codes, targets), strict=True))
    return {r["doc_id"] for r, x in zip(rows, labels, strict=True) if int(hashlib.md5(f"17|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13 < chance[x]}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        given, got = before.collect(), {r["doc_id"]: r for r in after.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if name == "toxicity":
            model = fit_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
            weigh = lambda w: model.lexicon.word_weight(w, None)
            score = model.score(np.array([features_of(r["text"], weigh) for r in given]))
            assert set(got) == {r["doc_id"] for r, s in zip(given, score, strict=True) if s < 0.5}
            marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [i for i, t in marked.items() if t == 0 and any(r["doc_id"] == i for r in given)]
            assert sum(i in got for i in clean) >= 0.97 * len(clean)
        elif name.startswith("n-gram"):
            assert set(got) == plain_components(given)
        elif name == "PII":
            mail = re.compile(r"[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}")
            for r in given:
                new = got[r["doc_id"]]
                old_mails, new_mails = mail.findall(r["text"] or ""), mail.findall(new["text"] or "")
                assert len(old_mails) == len(new_mails) and not {m.lower() for m in old_mails} & {m.lower() for m in new_mails}
                assert new["n_chars"] == len(new["text"]) and len((r["text"] or "").split("\n")) == len(new["text"].split("\n"))
                if not re.search(
                    r"[0-9@=]|[\"']|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Don|Doña|Господин|Госпожа|MRS?|MS|AKIA|ASIA|sk-|gh[pousr]_)", r["text"]):
                    assert new["text"] == r["text"]
        elif name.startswith("mixing"):
            assert set(got) == plain_mixture(given)
        else:
            tokenizer = Tokenizer.from_str(tokenizer_model())
            assert set(got) == {r["doc_id"] for r in given}
            for r in given:
                ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
                new = got[r["doc_id"]]
                assert new["ids"] == ids and new["n_tokens"] == len(ids) and (new["lang"], new["source"]) == (r["lang"], r["source"])
                assert new["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert new["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        before = after


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(12)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40_000))
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \n\t", "en", None, 3), (None, "one two three four five six", "de", "t", 27),
        (None, None, None, None, None)]
    rows += [(4, long, "en", "s", len(long)), (5, "x" * 100_000, "en", "s", 100_000), (6, "same row here", "en", "s", 13),
        (6, "same row here", "en", "s", 13), (7, "first text of seven", "en", "s", 19), (7, "second text of seven", "en", "s", 20),
        (7, None, "en", "s", None)]
    rows += [(8, "Mr. Smith, a@b.com", "fr", "u", 18)]
    extra = "score double, predicted string, n_entities string, topic int, n_words string, kept string, ids string, n_tokens string, component_id string"
    return spark.createDataFrame([(*r, 0.5, "p", "e", 1, "w", "k", "i", "n", "c") for r in rows], f"{SCHEMA}, {extra}")


def test_stages_with_awkward_rows(spark, awkward, tmp_path):
    for case, docs in (("rows", awkward), ("none", awkward.limit(0))):
        before = docs
        counts = []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{case}-{k}")
            stage(spark, before, SF).write.parquet(path)
            after = spark.read.parquet(path)
            counts.append(after.count())
            if k < 4:
                assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if case == "rows" and name.startswith("n-gram"):
                rows = after.collect()
                ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
                assert len(ids) == len(set(ids)) and {1, 2, 3} <= set(ids)
                texts = [t for t in ("first text of seven", "second text of seven")]
                assert [r["text"] for r in rows if r["doc_id"] == 7] == [min(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
                assert sum(r["doc_id"] is None for r in rows) == 2
            if case == "rows" and name == "PII":
                assert {r["doc_id"]: r["text"] for r in after.collect()}[1] is None
            before = after
        assert counts == [0] * 5 if case == "none" else counts[0] == docs.count() and counts[2] == counts[1] and counts[4] == counts[3]
