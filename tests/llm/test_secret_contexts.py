"""Secrets beside, inside and behind names, and secrets that occur more than once."""

import random
import string

import pytest

from wayfold.llm import secrets


def key(rnd, n=40):
    return "".join(rnd.choices(string.ascii_letters + string.digits, k=n))


NAMED = [
    "aws_secret_access_key = {}", 'private_key: "{}"', "encryption_key = {}", "privateKey: {}", "DB_PASS = {}", "client_secret_value: {}", "key={}", "bearer={}",
    "service_account_private_key_id={}", "{} is the signing key",
]


@pytest.mark.parametrize("form", NAMED)
def test_names_make_a_context(form):
    rnd, scanner, hits = random.Random(form), secrets.Scanner(), 0
    for _ in range(50):
        k = key(rnd)
        text = "some words before " + form.format(k) + " and more words"
        s = text.index(k)
        hits += any(a <= s and b >= s + 40 for a, _, b in scanner.spans(text)[1])
    assert hits >= 45


def test_plain_words_are_no_context():
    k = key(random.Random(1))
    for text in (f"the monkey {k} sat", f"a passage {k} here", f"turkey: {k}"):
        assert secrets.Scanner().spans(text)[1] == []


@pytest.mark.parametrize("n", [20, 40, 120, 300, 512])
@pytest.mark.parametrize("form", ["Bearer {0} key {0}", "curl -H 'Bearer {0}' a\ncurl -H 'Bearer {0}' b\ncurl -H 'Bearer {0}' c", "Bearer {0} and a plain line of words that goes on " + "and on " * 30 + "{0}"])
def test_copies_of_a_secret_are_all_found(form, n):
    rnd, scanner, hits = random.Random(n), secrets.Scanner(), 0
    for _ in range(40):
        k = key(rnd, n)
        text = "words before " + form.format(k) + " and more words"
        hits += len([s for s in scanner.spans(text)[1] if s[1] == 3 and text[s[0] : s[2]] == k]) == text.count(k)
    assert hits >= 36
