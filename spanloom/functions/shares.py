"""Secrets shared down a tree of gates: any k of a gate's children give its secret back, fewer tell nothing."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

#: A prime above every secret of 32 bytes that is below it: 2^256 - 189.
PRIME = (1 << 256) - 189

#: A policy: an attribute's name, or {"k": needed, "of": [policies]}.
Tree = str | dict


def gate(k: int, *of: Tree) -> dict:
    """Any k of some policies."""
    return {"k": k, "of": list(of)}


def every(*of: Tree) -> dict:
    """All of some policies."""
    return gate(len(of), *of)


def either(*of: Tree) -> dict:
    """One of some policies."""
    return gate(1, *of)


def written(tree: Tree) -> str:
    """A policy as text; gates that can't be met or have no children are an error."""

    def check(node: Tree) -> None:
        if isinstance(node, dict):
            if not 1 <= node["k"] <= len(node["of"]):
                raise ValueError("a gate needs between one and all of its children")
            for child in node["of"]:
                check(child)

    check(tree)
    return json.dumps(tree, sort_keys=True)


def holds(tree: Tree, owned: set[str]) -> bool:
    """Whether attributes meet a policy."""
    return tree in owned if isinstance(tree, str) else sum(holds(t, owned) for t in tree["of"]) >= tree["k"]


def split(tree: Tree, secret: int, seed: bytes, path: str = "") -> Iterator[tuple[str, str, int]]:
    """(path, attribute, share) of every leaf: a gate's secret is a polynomial's value at 0, its children's at 1, 2, ...

    The coefficients are drawn from ``seed``, which must be secret and another for every secret.
    """
    if isinstance(tree, str):
        yield path, tree, secret
        return
    draw = lambda i: int.from_bytes(hmac.new(seed, f"{path}|{i}".encode(), hashlib.sha512).digest(), "big") % PRIME
    terms = [secret, *[draw(i) for i in range(1, tree["k"])]]
    for x, child in enumerate(tree["of"], 1):
        value = 0
        for c in reversed(terms):
            value = (value * x + c) % PRIME
        yield from split(child, value, seed, f"{path}/{x}")


def joined(tree: Tree, shares: dict[str, int], path: str = "") -> int | None:
    """The secret that some leaves' shares give back, or None if they don't meet the policy."""
    if isinstance(tree, str):
        return shares.get(path)
    known = [(x, v) for x, child in enumerate(tree["of"], 1) if (v := joined(child, shares, f"{path}/{x}")) is not None][: tree["k"]]
    if len(known) < tree["k"]:
        return None
    total = 0
    for x, v in known:
        up, down = 1, 1
        for z, _ in known:
            if z != x:
                up, down = up * z % PRIME, down * (z - x) % PRIME
        total = (total + v * up * pow(down, -1, PRIME)) % PRIME
    return total
