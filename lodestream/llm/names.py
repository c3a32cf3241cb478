"""Names of persons by a logistic model of their words, their shape and what stands around them.

The model is fitted, where it is used first, on sentences made of the lists below: names of many languages in places
where names stand, and places, institutions, headings and other capitals in theirs. What it learns of a name are its
first and last letters, so names outside of the lists are found where their surroundings speak for one. A fit takes about
a second, and gives the same model everywhere.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np

from lodestream.llm.linear import fit_logistic

GIVEN = (
    "amara chidi ngozi kwame babatunde folake sipho nomsa tendai chipo abena kofi zanele lerato arjun ananya deepak lakshmi sanjay priyanka vikram kavita suresh meena anil divya hiroshi keiko takeshi sakura kenji haruto naoko "
    "ming hua jun xin mei liang ahmed fatima omar layla hassan yusuf aisha khalid samira tariq nadia seojun jiwoo minho hana linh minh thanh lan dmitri sergei oksana katarzyna piotr agnieszka jakub zofia tomasz lars astrid bjorn sven freja giovanni "
    "lorenzo chiara matteo giulia mehmet ayse emre elif joao thiago camila rafael beatriz pierre camille antoine sylvie lukas johanna klara matthias jorge lucia rosa ignacio brian laura jason megan tyler ashley sean fiona liam niamh gareth rhys"
).split()
FAMILY = (
    "smith johnson williams brown jones miller davis wilson taylor clark lewis walker hall allen young king wright scott green baker adams nelson carter campbell murphy okafor adebayo nwosu mensah dlamini ndlovu mokoena banda owusu eze sharma patel "
    "singh gupta reddy iyer nair chatterjee verma desai suzuki sato yamamoto nakamura kobayashi watanabe chen liu huang zhao lin wu kim park lee choi jung tran pham hoang bui al-masri al-rashid haddad khoury mansour hussein kowalski nowak wisniewska "
    "wojcik petrov ivanov smirnova volkov müller schmidt schneider fischer weber becker hoffmann rossi russo ferrari bianchi romano garcia martinez rodriguez lopez hernandez silva santos oliveira pereira yilmaz kaya demir andersson johansson hansen "
    "nielsen dubois moreau laurent lefebvre girard jansen bakker o'connor mcdonald macleod"
).split()
PLACES = "falls airport street road avenue lane drive square bridge river lake mountain mountains valley bay beach island islands county city town village station hospital school college university institute museum library church cathedral castle park gardens forest desert ocean sea coast republic kingdom states province district region north south east west hotel tower hall house center centre theatre stadium market mall reef canyon creek hills heights plaza pier harbor canal peninsula".split()
GROUPS = "company corporation inc ltd group bank times post journal magazine review press records studios foundation association society union league committee council commission ministry department office agency court party army navy police club team orchestra band festival award prize act treaty agreement war league cross nations project program system software engine api model series edition version report guide index license licence copyright".split()
COMMON = "great new old royal national international general central global united first modern grand golden silver black white red blue big little high low northern southern eastern western digital public open free best top daily weekly annual".split()
HEADS = "getting started learning building understanding using making finding writing reading managing improving data science machine deep cloud web security network quality training language analysis design development business health food travel music history art law market energy climate water privacy policy terms service contact about home page news sports support customer product order shipping payment account user password sign read click learn see show next previous mark log set".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
AREAS = "london paris berlin madrid rome vienna york jersey orleans zealand zurich sydney toronto chicago boston victoria charlotte florence san los santa saint st lake mount fort cape port mont monte rio africa america asia europe england france germany spain italy china india japan canada mexico brazil australia arabia egypt kenya korea russia turkey poland ireland scotland".split()

#: Given names that are words too.
WORDS = "mark will may grant bill frank rose grace hope drew".split()

_WITH = [
    "My name is {n}.", "my name is {n} and I live here", "I am {n}, the owner", "Hello, this is {n} speaking", "signed by {n} in May", "said {n} on the phone", "according to {n}, it was late", "{n} said that it works", "{n} told us the story", "Dear {n},",
    "Regards,\n{n}", "Best wishes, {n}", "contact {n} at the office", "please ask {n} about it", "a letter from {n} to {n}", "written by {n}", "by {n} and {n}", "{n} was born in the town", "{n} lives near the sea", "the patient {n} was seen", "employee {n} asked",
    "{n} <mail>", "cc {n} and the team", "I met {n} yesterday", "she married {n} in spring", "thanks to {n} for the help", "the author, {n}, writes", "{n}, who came late", "{n} and {n} went home", "call {n} today", "{n}'s house is old", "with {n} and others", "Yesterday {n} arrived",
    "ich heiße {n} und", "mein Name ist {n}", "von {n} geschrieben", "sagte {n} heute", "je m'appelle {n}", "écrit par {n}", "selon {n}, il", "me llamo {n} y", "dijo {n} ayer", "escrito por {n}", "director {n} spoke", "president {n} spoke", "sent to {n}", "Name: {n}", "Attn: {n}", "{n}, manager", "for {n}, with love", "{n}",
    "our neighbour {n} came", "the teacher {n} and", "{n} has a dog", "{n} will come", "Then {n} left",
]
_WITHOUT = [
    "in {x}", "at {x} today", "the {x} is open", "near {x} and", "visit {x} soon", "from {x} to {x}", "The {x}", "{x} is closed", "of the {x}", "to {x} by train", "a {x} in town", "{x}: what to know", "{x}", "our {x} page", "this {x} was", "by the {x}", "with the {x} and", "on {x}", "see {x} for more", "Welcome to {x}", "around {x}",
    "through {x} and", "an {x} of", "{x} opens", "{x} was founded", "flights to {x}", "die {x} ist", "im {x} war", "à {x} et", "en {x} y", "{x} and {x}", "how to {x}", "{x} the page", "| {x} | {x} |", "Chapter: {x}",
]
_RUN = re.compile(r"[A-ZÀ-ÖØ-ÞŁŚŻŠČŽĞİ][^\W\d_]*(?:['’-][^\W\d_]+)*(?: [A-ZÀ-ÖØ-ÞŁŚŻŠČŽĞİ][^\W\d_]*(?:['’-][^\W\d_]+)*)+")
_BEFORE, _BEHIND = re.compile(r"([^\W\d_]+)?[ ]*([^\w\s]?)(\s*)\Z"), re.compile(r"(['’]s)?\s*([^\w\s]?)[ ]*([^\W_]+)?")
_BUCKETS = 1 << 16
_LISTED = {"g": frozenset(GIVEN), "f": frozenset(FAMILY), "p": frozenset(PLACES + GROUPS), "c": frozenset(COMMON + HEADS), "d": frozenset(DAYS), "a": frozenset(AREAS)}


def features(first: str, second: str, before: str, behind: str, listed: bool = True) -> list[str]:
    """What the model sees of two words with capitals and of the text around them. listed: whether it sees the lists."""
    out = []
    for place, word in (("1", first), ("2", second)):
        low = word.lower()
        out += [f"{place}^{low[:2]}", f"{place}${low[-2:]}", f"{place}${low[-3:]}", f"{place}#{min(len(low), 9)}", f"{place}s{word.istitle()}{'-' in word}"]
        groups = [k for k, words in _LISTED.items() if low in words and (listed or k not in "gf")]
        out += [f"{place}@{k}" for k in groups] or [f"{place}@none"]
        if not set(groups) & set("gf"):
            out.append(f"{place}={low}")
    word, sign, space = _BEFORE.search(before[-40:]).groups()
    tail, sign2, word2 = _BEHIND.match(behind).groups()
    near, far = (word or "").lower(), (word2 or "").lower()
    out += [f"b={near}{sign}", f"b'{sign or ('' if word else 'none')}", f"bn{chr(10) in space}", f"bc{bool(word) and word[0].isupper()}", f"a={far}", f"a'{sign2}{bool(tail)}", f"ac{bool(word2) and word2[0].isupper()}"]
    return out


def _row(found: list[str]) -> np.ndarray:
    return np.array(sorted({zlib.crc32(f.encode()) % _BUCKETS for f in found}), np.int64)


def pairs(text: str):
    """The words with capitals that stand side by side: start and end of each two."""
    for run in _RUN.finditer(text):
        words = [(m.start() + run.start(), m.end() + run.start()) for m in re.finditer(r"[^ ]+", run[0])]
        yield from zip(words, words[1:], strict=False)


@lru_cache(maxsize=1)
def _model() -> tuple[np.ndarray, float]:
    rng = random.Random(1)
    title = lambda w: "-".join(p[:1].upper() + p[1:] for p in w.split("-"))
    name = lambda: f"{title(rng.choice(GIVEN + WORDS))} {title(rng.choice(FAMILY))}"
    places, heads = PLACES + GROUPS, COMMON + HEADS

    def other() -> str:
        kind = rng.randrange(9)
        if kind == 0:
            return f"{title(rng.choice(AREAS))} {title(rng.choice(places))}"
        if kind == 1:
            return f"{title(rng.choice(GIVEN + FAMILY))} {title(rng.choice(places))}"
        if kind == 2:
            return f"{title(rng.choice(heads))} {title(rng.choice(places))}"
        if kind == 3:
            return f"{title(rng.choice(heads))} {title(rng.choice(heads))}"
        if kind == 4:
            return f"{title(rng.choice(COMMON))} {title(rng.choice(AREAS))}"
        if kind == 5:
            return f"{title(rng.choice(DAYS))} {title(rng.choice(heads))}"
        if kind == 6:
            return f"{rng.choice(['The', 'This', 'In', 'On', 'My', 'Our', 'A', 'For', 'With', 'Der', 'Die', 'Le', 'La', 'El'])} {title(rng.choice(heads + places + GIVEN))}"
        if kind == 7:
            return f"{title(rng.choice(WORDS))} {title(rng.choice(['up', 'be', 'out', 'the', 'it', 'you', 'we', 'they', 'this', 'all']))}"
        return f"{title(rng.choice(AREAS))} {title(rng.choice(AREAS + heads))}"

    rows, label = [], []
    for template in _WITH * 40 + _WITHOUT * 70:
        inserted: list[tuple[int, int]] = []
        text = ""
        for part in re.split(r"(\{[nx]\})", template):
            new = name() if part == "{n}" else other() if part == "{x}" else part
            if part == "{n}":
                inserted.append((len(text), len(text) + len(new)))
            text += new
        for (a, b), (c, d) in pairs(text):
            # a list that is always seen would leave nothing to the rest
            rows.append(_row(features(text[a:b], text[c:d], text[:a], text[d:], rng.random() < 0.35)))
            label.append((a, d) in inserted)
    weights, bias = fit_logistic([(r, np.ones(len(r))) for r in rows], np.array(label, float), steps=150, rate=0.1, decay=2.0)
    return weights[:_BUCKETS].copy(), bias


#: The least probability of a name.
LEAST = 0.8
_CAPITALS_BEFORE = re.compile(r"(?:[^\W\d_a-z][^\s\d_]* ){2}\Z")
_CAPITALS_BEHIND = re.compile(r"(?: [^\W\d_a-z][^\s\d_]*){2}")


def is_name(first: str, second: str, before: str, behind: str, least: float = LEAST) -> bool:
    """Whether two words with capitals are a given and a family name, with what stands before and behind them.

    A word that is repeated isn't one, nor are two in a row of words with capitals, as in headings.
    """
    if first == second or _CAPITALS_BEFORE.search(before) or _CAPITALS_BEHIND.match(behind):
        return False
    weights, bias = _model()
    return float(weights[_row(features(first, second, before, behind))].sum()) + bias > np.log(least / (1 - least))
