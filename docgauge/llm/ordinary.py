"""Tokens that look much like secrets and are none: examples for the field to leave alone.

Each kind draws its parts anew, so that what is learnt is the kind's shape: words
and numbers between marks, one short run of letters beside one long run of digits.
UUIDs count as identifiers, not as secrets.
"""

from __future__ import annotations

import random
import string

_LETTERS, _DIGITS, _HEX = string.ascii_lowercase, string.digits, "0123456789abcdef"


def _some(draw: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    return "".join(draw.choices(alphabet, k=draw.randint(low, high or low)))


def _word(draw: random.Random) -> str:
    """Letters that can be spoken, as most words' can."""
    return "".join(draw.choice("bcdfghklmnprstvw") + draw.choice("aeiou") + draw.choice(["", "", "n", "r", "s"]) for _ in range(draw.randint(1, 4)))


def _words(draw: random.Random, mark: str, low: int = 2, high: int = 4) -> str:
    return mark.join(_word(draw) for _ in range(draw.randint(low, high)))


def _date(draw: random.Random, mark: str) -> str:
    return f"{draw.randint(1970, 2039)}{mark}{draw.randint(1, 12):02}{mark}{draw.randint(1, 28):02}"


def _version(draw: random.Random) -> str:
    return ".".join(str(draw.randint(0, 30)) for _ in range(draw.randint(2, 4))) + draw.choice(["", "", f"-rc{draw.randint(1, 9)}", f"+build.{_date(draw, '')}", f"-{_word(draw)}{draw.randint(1, 99)}"])


def _address(draw: random.Random) -> str:
    path = "/".join(draw.choice([_word(draw), _words(draw, "-"), _date(draw, "/"), str(draw.randint(1, 99999)), f"{_word(draw)}{draw.randint(1, 99)}"]) for _ in range(draw.randint(1, 5)))
    query = draw.choice(["", "", f"?{_word(draw)}={draw.randint(1, 10**6)}", f"?{_word(draw)}={_word(draw)}&{_word(draw)}={draw.randint(1, 999)}"])
    return f"http{draw.choice(['', 's'])}://{draw.choice(['', 'www.'])}{_word(draw)}.{draw.choice(['com', 'org', 'net', 'example.com', 'co.uk'])}/{path}{draw.choice(['', '', '/', '.html', '.php'])}{query}"


def _path(draw: random.Random) -> str:
    return draw.choice(["/", "./", "~/", "C:/", ""]) + "/".join(draw.choice([_word(draw), _word(draw), f"{_word(draw)}{_version(draw)}", _words(draw, draw.choice("-_"))]) for _ in range(draw.randint(3, 7))) + draw.choice(["", ".txt", ".py", ".json", ".tar.gz", f".{_word(draw)}"])


def _cased(draw: random.Random) -> str:
    return "".join(_word(draw).capitalize() for _ in range(draw.randint(2, 5))) + draw.choice(["", str(draw.randint(1, 999)), "V2"])


def _file(draw: random.Random) -> str:
    stem = draw.choice([f"{_word(draw).upper()}_{_date(draw, '')}_{_some(draw, _DIGITS, 6)}", _words(draw, draw.choice("-_")) + str(draw.randint(1, 999)), f"{_word(draw)}-{_date(draw, '-')}", f"{_word(draw)}{_some(draw, _DIGITS, 3, 8)}"])
    return stem + "." + draw.choice(["jpg", "pdf", "tar.gz", "parquet", "mp4", "csv", "docx"])


#: By name, how one is drawn.
KINDS = {
    "address": _address,
    "path": _path,
    "file": _file,
    "version": lambda d: d.choice([_version(d), f"v{_version(d)}", f"{_word(d)}-{_version(d)}", f"{_words(d, '-')}-{_version(d)}-cp3{d.randint(8, 14)}-{_word(d)}_x86_64.whl"]),
    "book": lambda d: f"{d.choice(['ISBN-', 'ISBN:', 'ISBN ', 'ISSN-', ''])}97{d.choice('89')}-{d.randint(0, 9)}-{d.randint(10, 999)}-{d.randint(1000, 99999)}-{d.choice(_DIGITS + 'X')}",
    "account": lambda d: d.choice([_some(d, string.ascii_uppercase, 2) + _some(d, _DIGITS, 16, 26), "-".join(_some(d, _DIGITS, 4) for _ in range(4)), _some(d, _DIGITS, 16, 19), _some(d, string.ascii_uppercase, 2) + _some(d, _DIGITS, 2) + " " + " ".join(_some(d, _DIGITS, 4) for _ in range(4))]),
    "phone": lambda d: d.choice(["+", "00", "("]) + d.choice([_some(d, _DIGITS, 10, 14), "-".join(_some(d, _DIGITS, 2, 4) for _ in range(4)), f"{_some(d, _DIGITS, 3)}) {_some(d, _DIGITS, 3)}-{_some(d, _DIGITS, 4)}"]),
    "order": lambda d: d.choice(["", "#"]) + _some(d, string.ascii_uppercase, 2, 5) + d.choice("-_/") + _some(d, _DIGITS, 4, 12) + d.choice(["", f"-{_some(d, string.ascii_uppercase, 1, 3)}", f"/{d.randint(1, 99)}"]),
    "identifier": lambda d: d.choice([_words(d, "_", 2, 6) + d.choice(["", f"_{d.randint(1, 9999)}"]), _cased(d), _cased(d) + "." + _words(d, "_"), _words(d, ".", 3, 6), _words(d, "-", 3, 6) + d.choice(["", f"-{d.randint(1, 9999)}"]), _words(d, "_", 2, 5).upper()]),
    "time": lambda d: _date(d, d.choice(["-", "/", "."])) + d.choice(["T", "_"]) + f"{d.randint(0, 23):02}:{d.randint(0, 59):02}:{d.randint(0, 59):02}" + d.choice(["Z", "", f".{_some(d, _DIGITS, 3, 6)}Z", "+02:00"]),
    "mail": lambda d: f"{_words(d, d.choice('._'))}{d.choice(['', str(d.randint(1, 9999))])}@{_words(d, '.')}.{d.choice(['com', 'org', 'de'])}",
    "host": lambda d: d.choice([".".join(str(d.randint(0, 255)) for _ in range(4)) + d.choice(["", f":{d.randint(1, 65535)}", "/24"]), f"ip-{'-'.join(str(d.randint(0, 255)) for _ in range(4))}.{_word(d)}.internal", ":".join(_some(d, _HEX, 2) for _ in range(6)), f"{_word(d)}{d.randint(1, 99)}.{_words(d, '.')}.net"]),
    "uuid": lambda d: d.choice([str.lower, str.upper])("-".join(_some(d, _HEX, n) for n in (8, 4, 4, 4, 12))),
    "number": lambda d: d.choice([f"{d.randint(1, 10**12):,}", f"{d.uniform(0, 10**6):.{d.randint(6, 14)}f}", f"{d.random():.12e}", _some(d, _DIGITS, 12, 30)]),
    "paper": lambda d: d.choice([f"10.{_some(d, _DIGITS, 4, 5)}/{_word(d)}.{d.randint(1990, 2039)}.{_some(d, _DIGITS, 4, 8)}", f"arXiv:{_some(d, _DIGITS, 4)}.{_some(d, _DIGITS, 5)}v{d.randint(1, 9)}", f"S{_some(d, _DIGITS, 4)}-{_some(d, _DIGITS, 4)}({d.randint(10, 99)}){_some(d, _DIGITS, 5)}-{d.randint(0, 9)}"]),
}


def ordinary(draw: random.Random, kinds: tuple[str, ...] = tuple(KINDS)) -> str:
    """One token or a few, of one of `kinds`."""
    return KINDS[draw.choice(kinds)](draw)
