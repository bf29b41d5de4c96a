"""Disguises of each kind, planted in plain sentences."""

import pytest

from logweave.llm import pii

PLANTED = [
    ("ip", "192 dot 168 dot 1 dot 10"),
    ("ip", "192.168 punkt 1 dot 10"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "192 dot one six eight dot 1 (dot) one-zero"),
    ("email", "joe at example.com"),
    ("email", "joe dot smith at example dot com"),
    ("email", "joe dot a dot smith at mail.example dot co dot uk"),
    ("email", "joe dot smith [at] example dot com"),
    ("email", "joe.smith @ example dot com"),
    ("email", "joe dot smith@example dot com"),
]


@pytest.mark.parametrize("kind,text", PLANTED)
def test_disguise_is_found_and_masked(kind, text):
    for before, after in (("write to ", " now"), ("", ""), ("number five: ", ", please.")):
        t = before + text + after
        b, a = pii.find(t)
        assert [t[x:y] for x, y in b[kind] + a[kind]] == [text]
        assert pii.mask(t, pii._render({k: b[k] + a[k] for k in pii.KINDS})) == f"{before}<{kind.upper()}>{after}"


def test_digit_words_before_an_address_stay_apart():
    t = "number five one nine two dot one six eight dot zero dot one"
    assert [t[x:y] for x, y in pii.find(t)[1]["ip"]] == ["one nine two dot one six eight dot zero dot one"]


def test_prose_is_left_alone():
    for t in ("one dot two dot three", "we met at home. They left", "at 10.30 we sat at table 4.", "300 dot 1 dot 1 dot 1", "dot at example, dot", "a dot, a point and two points"):
        assert not any(pii.find(t)[1].values()), t


def test_long_texts_are_linear():
    for t in ("a at " * 50_000, "a dot " * 50_000, "one dot " * 50_000, "a at b dot " * 30_000, "1 dot " * 50_000, " at a" + ".a1" * 50_000, "a@" + "b." * 50_000 + " at "):
        pii.find(t)
