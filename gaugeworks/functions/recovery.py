"""Recovery of a chosen key from free text, in named stages; a row that no stage settles stays unrecovered.

A reply is read once into tokens, each with the key that it stands for, if any. Every later rule is a scan over those tokens.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and symbols that the stages know, and their windows.
STRIPPED = "*_`\"' \t\n()[]{}<>.,:;!?/|\\-+=~^%"
CUES = frozenset({"answer", "option", "choice", "key", "ans"})
LINKS = frozenset({"is", "are", "was", "were", "the", "single", "best", "correct", "final", "to", "be", "of", "my", "our", "one", "answer", "option", "choice", "key", "given", "therefore", "thus", "so", "then", "must", "would", "will"})
DENIALS = frozenset({"not", "wrong", "incorrect", "false", "never", "unlikely", "impossible", "mistake", "except", "cannot", "cant", "isnt", "wasnt", "no"})
LEADING_DENIALS = frozenset({"not", "never", "no"})
EITHER = frozenset({"or", "alternatively", "maybe", "perhaps"})
CUE_REACH, AFTER_KEY, QUALIFIER, TAIL = 8, 4, 3, 40


@dataclass(frozen=True)
class Token:
    word: str
    exact: str | None  # key by its own spelling, or by any case if it has several letters
    loose: str | None  # key by any case


class Keys:
    """The allowed keys of a question."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.own = set(keys)
        folded: dict[str, set[str]] = {}
        for k in self.own:
            folded.setdefault(k.lower(), set()).add(k)
        self.folded = {f: next(iter(ks)) for f, ks in folded.items() if len(ks) == 1}

    def read(self, word: str) -> Token:
        loose = word if word in self.own else self.folded.get(word.lower())
        return Token(word.lower(), loose if word in self.own or len(word) > 1 else None, loose)

    def tokens(self, text: str) -> list[Token]:
        return [self.read(w) for w in re.findall("[A-Za-z0-9]+", text)]


def stated(tokens: list[Token]) -> str | None:
    """The key of the last explicit statement that is neither denied nor left open."""
    for at in range(len(tokens) - 1, -1, -1):
        if tokens[at].word in CUES and (key := _statement(tokens, at)):
            return key
    return None


def _statement(tokens: list[Token], cue: int) -> str | None:
    for at in range(cue + 1, min(cue + 1 + CUE_REACH, len(tokens))):
        if tokens[at].word in LINKS:
            continue
        if tokens[at].loose is None:
            return None
        # What follows within the cue's reach may take the statement back.
        stop = min(at + 1 + AFTER_KEY, cue + 1 + CUE_REACH, len(tokens))
        for k in range(at + 1, stop):
            other = any(t.loose for t in tokens[k + 1 : min(k + 1 + QUALIFIER, stop)])
            if tokens[k].word in EITHER and other or tokens[k].word in DENIALS and not other:
                return None
        return tokens[at].loose
    return None


def mentioned(tokens: list[Token]) -> str | None:
    """The one key that is mentioned and not denied, if it is the only one."""
    found = {t.exact for at, t in enumerate(tokens) if t.exact and not _denied(tokens, at)}
    return found.pop() if len(found) == 1 else None


def _denied(tokens: list[Token], at: int) -> bool:
    if any(t.word in LEADING_DENIALS for t in tokens[max(0, at - 2) : at]):
        return True
    return any(
        tokens[k].word in DENIALS and not any(t.loose for t in tokens[k + 1 : k + 4]) for k in range(at + 1, min(at + 4, len(tokens)))
    )


def recover(text: str | None, keys: Sequence[str], reasoning: str | None = None) -> tuple[str | None, str]:
    """The key and the stage that found it."""
    allowed, said = Keys(keys), (text or "").strip()
    if not said:
        thought = (reasoning or "").strip()
        key = stated(allowed.tokens(thought)) or mentioned(allowed.tokens(thought[-TAIL:]))
        return (key, "reasoning_channel") if key else (None, "unrecovered")
    whole = lambda s: None if " " in s and s not in allowed.own else allowed.read(s).exact
    last = said.splitlines()[-1].strip().strip(STRIPPED)
    tokens = allowed.tokens(said)
    stages = (
        ("exact", lambda: whole(said)),
        ("stripped", lambda: whole(said.strip(STRIPPED))),
        ("final_line_key", lambda: allowed.read(last).exact if last and not any(c.isspace() for c in last) else None),
        ("answer_pattern", lambda: stated(tokens)),
        ("isolated_key", lambda: mentioned(tokens)),
    )
    for stage, find in stages:
        if key := find():
            return key, stage
    return None, "unrecovered"


def recovered(text: Column, keys: Sequence[str]) -> Column:
    """struct(key, stage) of a text column, in Arrow batches."""
    allowed = list(keys)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([recover(t, allowed) for t in texts], columns=["key", "stage"])

    return F.pandas_udf(run, "key string, stage string")(text)
