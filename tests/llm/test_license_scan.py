import re

from tessaprobe.llm import license_scan as ls
from tests.llm.conftest import invented

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    words = WORD.findall(lower(text))
    starts, labels = [], set()
    for phrase, label in ls.BASE:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        if own:
            labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def brute_labels(text):
    """Every template at every place, without an index."""
    words, out = WORD.findall(lower(text)), set(filter(None, brute(text)[4].split(",")))
    for t in ls.parsed(ls.TEMPLATES):
        for o in range(-len(t.words), len(words)):
            at = [words[o + i] if 0 <= o + i < len(words) else None for i in range(len(t.words))]
            agree = sum(a == b for a, b in zip(at, t.words, strict=True)) / len(t.words)
            if at[t.first : t.last + 1] == list(t.words[t.first : t.last + 1]) and agree >= 0.8:
                out.add(t.label)
    return ",".join(sorted(out))


TEXTS = [
    None, "", " .\n", "CC-BY 4.0", "Licensed under CC BY-NC 4.0.", "All Rights Reserved, all rights reserved", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "licensed the apache license under version 2 0", "mit license", "under the mit license", "license " * 400,
    "É all\x00rights\x7freserved ÀÉ É", "general public", "the gnu lesser general public license applies under the terms of the gnu lesser general public license", "allrights reserved all rights", "cc by cc by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "wholly rights Kreserved",
]


def test_equal_to_brute_force(documents):
    texts = TEXTS + [f"{invented(i, 30)}\n{TEXTS[4 + i % 10]}\n{invented(i + 50, 1 + 40 * i)}" for i in range(20)] + ["plain words " * 20000 + "all rights reserved"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, TEXTS[3]), (None, "cc by")]
    got = ls.scanned(documents(rows, ("words", "spaced", "label"))).collect()
    assert len(got) == len(rows)
    by_id = {g.doc_id: g for g in got}
    for doc_id, text in rows:
        g = by_id[doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(text), text and text[:60]
        assert g.labels == brute_labels(text), text and text[:60]
        assert 0 <= g.score <= 1 and (g.score > 0) == (g.labels != "")


def test_empty_table(documents):
    assert ls.scanned(documents([])).collect() == []


def test_every_template_is_found_in_full_text_and_templates_are_a_parameter(documents):
    rows = [(i, f"{invented(i, 20)} {text.replace('[', '').replace(']', '')} {invented(i + 1, 20)}") for i, (_, text) in enumerate(ls.TEMPLATES)]
    got = {g.doc_id: g.labels for g in ls.scanned(documents(rows)).collect()}
    assert all(ls.TEMPLATES[i][0] in labels.split(",") and labels == brute_labels(rows[i][1]) for i, labels in got.items())
    many = tuple((f"own-{i}", f"{invented(900 + i, 4)} [{invented(100 + i, 5, 10**6)}] {invented(800 + i, 4)}") for i in range(90))
    rows = [(i, f"x {text.replace('[', '').replace(']', '')} y") for i, (_, text) in enumerate(many)] + [(500, " ".join(t.replace("[", "").replace("]", "") for _, t in many))]
    got = {g.doc_id: g.labels for g in ls.scanned(documents(rows), ls.Scan(templates=many)).collect()}
    assert all(got[i] == f"own-{i}" for i in range(90)) and set(got[500].split(",")) == {t for t, _ in many}
