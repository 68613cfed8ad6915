"""Languages by their function words.

A row's language is the one most of whose function words it holds. A row with hardly any
of them is of no known language (``OTHER``): its function words aren't judged.
"""

from __future__ import annotations

import functools

import numpy as np

from garimpo.functions.text import STOP_WORDS
from garimpo.llm import wordtable as wt

LANGUAGES = ("pt", "en", "es", "fr", "it", "de", "nl")
OTHER = len(LANGUAGES)
CAPITAL_NOUNS = (LANGUAGES.index("de"),)
KNOWN_FROM = 0.2  # share of function words from which a row is of a known language
SLOTS = 1 << 18
# Closed-class words of each language (articles, pronouns, prepositions, conjunctions, auxiliaries), frequent ones first.
FUNCTION_WORDS = {
    "pt": """de a o e do da os as dos das em no na nos nas ao à aos às um uma por pelo pela pelos pelas para com sem sob que se não mais
        como é são foi ser está sua seu ou ante após até contra desde durante perante conforme mediante segundo além dentro caso porque
        porém embora cada todo toda todos todas outro outra outros outras qualquer onde ainda assim entre sobre quando""",
    "en": """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were
        her all she there would their we him been has when who will no more if out so up said what its about than into them can only
        other some could these two may then do any my now over such our me even must should shall might where those through because
        before after between under without within although though while during against until upon each every nor whether both your
        whose am did does being how very just us i too here own same few most again once""",
    "es": """de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre
        cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así
        nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e otro después te otros aunque esa eso hace otra durante
        siempre tan contra antes nosotros ustedes ellos ellas ante bajo según tras mediante cual quien cuyo tal será han sido""",
    "fr": """de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la cette avec ou son elle mais
        nous sans vous être leur ont aux d l s n c j m t qu y comme ses fait tout on même ces ils lui si où je peut deux été dont
        entre très aussi avait bien était sous après avant leurs elles encore non peu notre votre chaque quand donc car ni mon ma
        mes ton ta tes sa nos vos selon contre depuis pendant vers chez lors afin puis ainsi quoique lorsque sera ont doit""",
    "it": """di e il la che in a un per è una non del con si da sono le dei come i al più della anche alla ma nel gli dal ha o su lo suo
        ai delle nella loro se ci sua essere questo stato era cui degli dalla alle quando dopo tra molto sul senza fra dell all l
        un nell sull sulla negli nelle agli dai tutti tutto così ancora prima ogni mentre perché dove chi noi voi lui lei mi ti vi
        questa questi queste quello quella sia hanno aveva fu né può deve quale quali secondo durante contro presso""",
    "de": """der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
        wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei
        hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine
        seiner worden will zwischen immer was sagte gibt alle muss ihr ihm ihn uns mich doch jedoch ohne während sowie weil ob da
        hier dort damit dies diesem diesen jeder jede sollen müssen dürfen darf""",
    "nl": """de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft hij ze wordt door
        over ze zich hun dit worden wel die was meer tot hebben kan ik had wij geen moet al zou nu na tegen zo omdat deze onder
        tussen zonder je haar hem mijn ons onze u men wie wat waar hoe toen toch daar hier zij werd waren elke ieder tijdens""",
}


def words_of(language: str) -> list[str]:
    extra = STOP_WORDS if language == "pt" else []
    return list(dict.fromkeys([*FUNCTION_WORDS[language].split(), *extra]))


@functools.cache
def _table() -> tuple[np.ndarray, np.ndarray, np.uint64, np.ndarray]:
    """(slot to entry, hash of each entry, multiplier of the slots, entry x language: place of the word in its list or -1).

    The multiplier is the first that gives every function word a slot of its own.
    """
    lists = [words_of(x) for x in LANGUAGES]
    entries = list(dict.fromkeys(w for words in lists for w in words))
    keys = np.array([0, *(wt.hash_word(w) for w in entries)], np.uint64)
    number = {w: i + 1 for i, w in enumerate(entries)}
    places = np.full((len(keys), OTHER + 1), -1, np.int16)
    for k, words in enumerate(lists):
        for i, w in enumerate(words):
            places[number[w], k] = i
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    while len(np.unique(at := _slots(keys[1:], multiplier))) < len(entries):
        multiplier += np.uint64(2)
    slot = np.zeros(SLOTS, np.uint16)
    slot[at] = np.arange(1, len(keys))
    return slot, keys, multiplier, places


def _slots(core: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    return ((core * multiplier) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def row_language(w: wt.Words) -> tuple[np.ndarray, np.ndarray]:
    """(language number of each row, place of each word among the function words of its row's language or -1)."""
    if len(w.row) == 0:
        return np.full(w.rows, OTHER), np.zeros(0, np.int64)
    slot, keys, multiplier, places = _table()
    entry = slot[_slots(w.core, multiplier)]
    entry[keys[entry] != w.core] = 0
    found = np.flatnonzero(entry)
    row, of = w.row[found], places[entry[found]] >= 0
    counts = np.stack([np.bincount(row, of[:, k], w.rows) for k in range(OTHER)])
    language = counts.argmax(axis=0)
    language[counts.max(axis=0) < KNOWN_FROM * np.bincount(w.row, minlength=w.rows)] = OTHER
    language[w.sizes == 0] = OTHER
    own = np.full(len(w.row), -1, np.int64)
    own[found] = places[entry[found], language[row]]
    return language, own
