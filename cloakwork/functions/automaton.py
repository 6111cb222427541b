"""Replacement of very many tokens in a text by way of an automaton that finds all of them in one reading."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

#: Tokens of one patient from which on their reports are cleaned by an automaton.
MANY_TOKENS = 200
#: Automata that a task keeps; rows of a patient lie together after the join by patient.
KEPT_AUTOMATA = 16


class TokenAutomaton:
    """The tokens in their order of replacement, found together."""

    def __init__(self, tokens: list[str | None]) -> None:
        from ahocorasick import Automaton

        self.tokens, places = [t for t in tokens if t], {}
        for k, token in enumerate(self.tokens):
            places.setdefault(token, []).append(k)
        self.find = Automaton()
        for token, at in places.items():
            self.find.add_word(token, at)
        self.find.make_automaton()

    def scrub(self, text: str, by: str) -> str:
        """What replacing one token after the other gives.

        Of the tokens that occur the first in order is replaced; what follows it in order is looked for again, since a replacement
        may make a token of what lies beside it. So the text is read once more than the number of tokens that are replaced.
        """
        done = -1
        while self.tokens:
            later = len(self.tokens)
            for _, places in self.find.iter(text):
                k = bisect_right(places, done)
                if k < len(places) and places[k] < later:
                    later = places[k]
            if later == len(self.tokens):
                break
            text, done = text.replace(self.tokens[later], by), later
        return text


def scrub_many(text: Column, tokens: Column, by: Column) -> Column:
    """scrub() for long lists of tokens, with the same result: null without text, list or replacement, null and empty tokens are passed over."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def scrubbed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held: OrderedDict[str, TokenAutomaton] = OrderedDict()

        def one(text: str | None, listed: str | None, by: str | None) -> str | None:
            if text is None or listed is None or by is None:
                return None
            if listed not in held:
                held[listed] = TokenAutomaton(json.loads(listed))
                if len(held) > KEPT_AUTOMATA:
                    held.popitem(last=False)
            held.move_to_end(listed)
            return held[listed].scrub(text, by)

        for texts, lists, replacements in batches:
            yield pd.Series([one(*row) for row in zip(texts, lists, replacements)], dtype=object)

    return scrubbed(text, F.to_json(tokens), by)


def many_tokens(tokens: DataFrame) -> bool:
    """Whether any patient has so many tokens that an automaton pays; one number comes to the driver."""
    return (tokens.agg(F.max(F.size("tokens"))).first()[0] or 0) >= MANY_TOKENS
