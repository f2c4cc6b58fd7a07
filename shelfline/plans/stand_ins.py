"""Deterministic stand-ins for a model, used by the registered queries.

Each is what a caller passes in: requests to replies.  They answer from the request text alone, so
their answers can be stated in SQL.
"""

from __future__ import annotations

import json
import zlib


def _products(request: str) -> list[tuple[str, str]]:
    """(id, title) of the item lines of a backfill request."""
    found, number = [], ""
    for line in request.split("\n"):
        if line.startswith("item="):
            number = line[len("item="):]
        elif line.startswith("name="):
            found.append((number, line[len("name="):]))
    return found


def category_model(requests: list[str]) -> list[str]:
    """"Goods > <first word>", "Other" for titles led by a maker, and one id nobody asked for."""
    replies = []
    for request in requests:
        answers = {n: "Other" if t.startswith("Brand") else "Goods > " + t.split(" ")[0]
                   for n, t in _products(request)}
        # An id of another batch: one before the first asked for.
        stray = str(min((int(n) for n in answers), default=0) - 1)
        replies.append("Sure:\n" + json.dumps({**answers, stray: "Nowhere > Stray"}) + "\nDone.")
    return replies


def brand_model(requests: list[str]) -> list[str]:
    """The first word of a title; "Unbranded" where it carries an offer."""
    return [json.dumps({n: "Unbranded" if "|" in t else t.split(" ")[0]
                        for n, t in _products(request)}, ensure_ascii=False)
            for request in requests]


def keyword_model(requests: list[str]) -> list[str]:
    """First two words, lower-cased; gift sets are blocked; every other reply is broken JSON."""
    replies = []
    for i, request in enumerate(requests):
        items = [json.loads(line) for line in request.split("\n")]
        answers = {item["id"]: "BLOCKED" if "Gift" in item["product"] else
                   " ".join(item["product"].lower().split(" ")[:2]) for item in items}
        body = json.dumps(answers, ensure_ascii=False)
        broken = int(items[0]["id"]) % 2 == 0
        replies.append("```json\n" + (body[:-1] + ",}" if broken else body) + "\n```")
    return replies


def phrase_model(requests: list[str]) -> list[str]:
    """Three quoted words on the second line."""
    return ['\n"' + " ".join(r.split("\n")[0].split(" ")[1:4]) + '"\nsomething else'
            for r in requests]


def _reviewed(request: str) -> list[tuple[int, str, str]]:
    """(number, title, category) of the items of a review request."""
    found = []
    for item in request.split("\n\n"):
        lines = item.split("\n")
        if not lines[0].startswith("#"):  # the line of categories
            continue
        number, title = lines[0].removeprefix("#").split(" ", 1)
        found.append((int(number), title, lines[2].removeprefix("filed under ")))
    return found


def review_model(requests: list[str]) -> list[str]:
    """Numbers by five: one line missing, one short, the rest by the title's length."""
    replies = []
    for request in requests:
        lines = []
        for number, title, category in _reviewed(request):
            if number % 5 == 0:
                continue
            if number % 5 == 1:
                lines.append(f"{number}|CORRECT")
            elif len(title) % 2:
                lines.append(f" {number}|correct|{category}|MEDIUM ")
            else:
                lines.append(f"{number}|INCORRECT| Whisky |{'HIGH' if number % 2 else 'Low'}")
        replies.append("\n".join(lines))
    return replies


def classify_model(requests: list[str]) -> list[str]:
    """The assigned category for short titles, "Goods" for long ones, nothing for every third."""
    return ["\n".join(f"{n}|{category if len(title) < 45 else 'Goods'}"
                      for n, title, category in _reviewed(request) if n % 3)
            for request in requests]


def check_model(requests: list[str]) -> list[str]:
    """A verdict in JSON; offers fail outright."""
    replies = []
    for request in requests:
        title, keyword = (line.split("= ", 1)[1] for line in request.split("\n", 1))
        if "|" in title:
            raise RuntimeError("offer in title")
        verdict = "TRUE" if title.lower().startswith(keyword) else "n"
        replies.append(json.dumps({"match": verdict, "reason": "by prefix"})
                       if "Brand" not in keyword else json.dumps({"match": verdict}))
    return replies


def pick_model(requests: list[str]) -> list[str]:
    """One brand for every title; nothing for gift titles."""
    return ["{}" if "gift" in r.lower() else '```json\n{"brand": "Pick", "vintage": null}\n```'
            for r in requests]


def unlucky(request: str) -> bool:
    """A third of all requests, by their text."""
    return zlib.crc32(request.encode()) % 3 == 0


def no_model(requests: list[str]) -> list[str]:
    raise AssertionError("everything was asked before")
