"""Surrogates: no collision and no fixed point in a full class, formats, check digits, coreference, more entities."""

import itertools
import random
import re

from folioframe.llm import pii


def test_full_classes():
    """All addresses of single digits, all short phone numbers and all short e-mail names: bijections without fixed points."""
    octets = ["".join(x) for x in itertools.product("0123456789", repeat=4)]
    for kind, every in (("ip", [".".join(x) for x in octets]), ("phone", [f"0|{x}" for x in octets]), ("ssn", octets), ("email", [f"{a}{b}@c{d}.org" for a, b, d in itertools.product("abcdefghij", "0123456789", "xyz")])):
        new = [pii.surrogate(kind, x) for x in every]
        assert len(set(new)) == len(every)
        assert all(a != b.replace("|", "") for a, b in zip(new, every, strict=True))
    assert set(pii.surrogate("ip", ".".join(x)) for x in octets) == {".".join(x) for x in octets}


def test_numbers_keep_their_checks():
    rng = random.Random(3)
    for _ in range(200):
        body = "4" + "".join(rng.choices("0123456789", k=14))
        card = pii.surrogate("card", body + str(pii.luhn(body)))
        assert pii.luhn(card[:-1]) == int(card[-1]) and card[0] == "4"
        other = pii.surrogate("account", body + str((pii.luhn(body) + 1) % 10))
        assert pii.luhn(other[:-1]) != int(other[-1])
        rest = "".join(rng.choices("0123456789", k=18))
        iban = pii.surrogate("iban", f"DE{pii._iban_check('DE', rest):02d}{rest}")
        assert int(iban[2:4]) == pii._iban_check("DE", iban[4:]) and iban[4:] != rest


def test_more_entities():
    find = lambda t: [(t[a:b], k) for a, b, k, _ in pii.find_entities(t)]
    assert find("pay FR76 3000 6000 0112 3456 7890 189 EUR now") == [("FR76 3000 6000 0112 3456 7890 189", "iban")]
    assert find("call 0171 555 1234 or 01 23 45 67 89, not 0171 55 or 01/02 2023") == [("0171 555 1234", "phone"), ("01 23 45 67 89", "phone")]
    assert find("from 2001:db8::ff00:42:8329 at 12:30:45") == [("2001:db8::ff00:42:8329", "ipv6")]
    assert find("Then Anna Smith wrote. Smith left. The Great War.") == [("Anna", "given_f"), ("Smith", "surname"), ("Smith", "surname")]
    new, _ = pii.replace_entities("Bob@X.com and bob@x.com, 2001:DB8::FF00:42:8329")
    one, two = re.findall(r"\S+@[\w.]+", new)
    assert one.lower() == two.lower() != "bob@x.com" and one[0].isupper() and "@" in one
    assert pii.replace_entities("FR76 3000 6000 0112 3456 7890 189")[0].count(" ") == 6


def test_table_with_a_full_class(spark):
    """All addresses of single digits in one table, twice, with odd ids and clashing columns."""
    ips = [".".join(x) for x in itertools.product("0123456789", repeat=4)]
    rows = [(str(i // 100), " ".join(["see", *ips[i : i + 100], "."])) for i in range(0, 10_000, 100)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows + rows[:1]] + [(None, None, 0, 0)], "doc_id string, text string, kinds int, _x int")
    out = pii.replace_pii(docs).collect()
    assert len(out) == 102
    got = {r["doc_id"]: r["text"].split()[1:-1] for r in out if r["text"]}
    assert sorted(sum(got.values(), [])) == sorted(ips)
    assert all(a != b for i, t in rows for a, b in zip(got[i], t.split()[1:-1], strict=True))
