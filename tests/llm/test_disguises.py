"""Disguised dots in addresses, hosts and local parts."""

import random
import time

import pytest

from curatrix.llm import deobfuscate


@pytest.mark.parametrize(
    "hidden,kind",
    [
        ("192[.]168[.]1[.]10", "ip"),
        ("192(dot)168(dot)1(dot)10", "ip"),
        ("10 dot 20 dot 30 dot 40", "ip"),
        ("10.20[.]30 dot 40", "ip"),
        ("john dot smith at example dot com", "email"),
        ("john [dot] smith [at] example [dot] com", "email"),
        ("john dot smith@example dot com", "email"),
        ("jane at mail.example dot com", "email"),
        ("a_ dot b_c (at) mail.example(dot)co.uk", "email"),
    ],
)
def test_dots_are_restored(hidden, kind):
    text = f"See: {hidden}, or not."
    found = deobfuscate.find_in_text(text)
    assert [(deobfuscate.KINDS[k], text[s:e], o) for k, s, e, o in found] == [(kind, hidden, "added")]
    assert deobfuscate.redact(text) == f"See: [{kind}], or not."


@pytest.mark.parametrize(
    "hidden,plain", [("jane@mail.example dot com", "jane@mail.example"), ("jo[dot]e@example.com", "e@example.com")]
)
def test_plain_spans_stay_and_redaction_covers_all(hidden, plain):
    text = f"See: {hidden}, or not."
    assert [(text[s:e], o) for _, s, e, o in deobfuscate.find_in_text(text)] == [(plain, "base")]
    assert deobfuscate.redact(text) == "See: [email], or not."


def test_other_numbers_are_left_alone():
    for text in ("10 dot 20 dot 30", "300 dot 1 dot 1 dot 1", "the dot 5 dot 6", "polka dot shirts at noon"):
        assert deobfuscate.redact(text) == text
    mail = "the red dot joe@example.com"
    assert deobfuscate.redact(mail) == "the red dot [email]"


def test_long_runs_take_little_time():
    start = time.time()
    for run in ("a dot ", "1 dot ", "1[.", "a@b ", "a@b dot ", "a" * 50 + " ", "1.", " ", "a at b "):
        deobfuscate.redact(run * (100_000 // len(run)) + " dot x")
    assert time.time() - start < 20


def test_time_grows_with_the_identifiers_of_a_text():
    def seconds(copies):
        text = "mail a@b.cc now " * copies + "john dot smith at example dot com"
        start = time.perf_counter()
        found = deobfuscate.find_in_text(text)
        assert sum(o == "base" for *_, o in found) >= copies
        assert [text[s:e] for *_, s, e, o in found if o == "added"] == [
            "john dot smith at example dot com"
        ]
        return time.perf_counter() - start

    seconds(100)
    small, large = seconds(2_000), seconds(32_000)
    assert large < 16 * small * 3 and large < 10


def test_spans_equal_those_of_plain_overlap_tests():
    parts = ["a@b.cc", "c at d dot ee", "10.0.0.1", "1 dot 2 dot 3 dot 4", "+1 555 123 4567", "plus one five five five 1234567",
             " and ", ", ", "x", "4111 1111 1111 1111", "four111 1111 1111 1111"]
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 12)))
        found = [(k, s, e, "base") for k, s, e in deobfuscate.identifiers(text)]
        out = deobfuscate.rewrite(text)
        for k, s, e in deobfuscate.identifiers(out.text) if out else ():
            a, b = out.source(s, e)
            if not any(k == x[0] and a < x[2] and x[1] < b for x in found):
                found.append((k, a, b, "added"))
        assert deobfuscate.find_in_text(text) == sorted(found)
