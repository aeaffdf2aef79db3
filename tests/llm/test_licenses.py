"""Spans are verified word after word, over merged diagonals."""

import random

import pytest
from tensorloom.llm.licenses import SENTENCES, Template, clauses, license_scan, templates

WORDS = dict((label, body) for label, body in SENTENCES if label in ("isc", "mpl", "zlib"))


def labels(one_text, *texts):
    return [r.labels for r in license_scan(one_text(*texts)).orderBy("doc_id").collect()]


@pytest.mark.parametrize("label", sorted(WORDS))
def test_order_counts(one_text, label):
    body = WORDS[label].split()
    mixed = [" ".join(x) for x in zip(body[0::2], body[1::2], strict=False)]
    random.Random(1).shuffle(mixed)
    added = body[:9] + ["really"] + body[9:]
    missing = body[:7] + body[9:]
    texts = [" ".join(x) for x in (body, ["é", "so:", *body, "and", "more"], added, missing, mixed, body[: len(body) // 3])]
    assert labels(one_text, *texts) == [label, label, label, label, "", ""]


def test_merged_span_is_whole(one_text):
    body = WORDS["isc"].split()
    text = "one two three " + " ".join(body[:9] + ["new", "words"] + body[9:])
    found = license_scan(one_text(text)).first()
    assert [tuple(x) for x in found.spans] == [(3, 3 + len(body) + 2, "isc")]


def test_every_template_finds_itself(one_text):
    every = templates()
    for t, found in zip(every, labels(one_text, *[" ".join(t.words) for t in every]), strict=True):
        assert t.label in found.split(",")


def test_two_copies_apart_and_a_copy_among_repeats(one_text):
    body = WORDS["mpl"]
    text = f"{body} . {body} . the terms " + "public license " * 200
    found = license_scan(one_text(text)).first()
    assert found.labels == "mpl" and len(found.spans) == 2


def test_templates_of_any_length(one_text):
    """A whole licence of 300 words finds its clauses, with words added and missing; what cannot vote is refused."""
    rng = random.Random(2)
    body = [f"term{rng.randrange(10_000)}" for _ in range(300)]
    whole = [Template("own", tuple(body), False)]
    part = " ".join(body[130:260])
    texts = [" ".join(body), "before " + " ".join([*body[:40], "extra", *body[40:200], *body[202:]]) + " after", part, " ".join(reversed(body))]
    found = license_scan(one_text(*texts), extra=whole).orderBy("doc_id").collect()
    assert [r.labels for r in found] == ["own", "own", "own", ""]
    assert len(found[0].spans) == len(clauses(whole[0])) and [found[0].spans[0][0], found[0].spans[-1][1]] == [0, 300]
    for bad in (Template("x", tuple(body), True), Template("x", ("one",), False), Template("x", ("of", "the"), False)):
        with pytest.raises(ValueError):
            license_scan(one_text("x"), extra=[bad])
