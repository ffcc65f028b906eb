"""Personal data: patterns with checks, and a linear-chain conditional random field.

The patterns give e-mail addresses, IP addresses, card and phone numbers. The field tags the white
space separated words of every text with names and secrets from word shapes and a few cue words.
It is trained on the driver from a small labelled table (at most ``MAX_LABELLED`` lines) by
gradient steps on the exact likelihood (forward-backward over padded numpy batches), and decoded
by Viterbi, also over batches.

Decoding first fixes the words whose score for "outside" exceeds every other label by more than
any two transitions can gain: the best path must be outside there, so it falls apart into short
runs between such words, each decoded as one row of a padded batch. That is exact.

Cases: a null or empty text has no spans; equal keys and repeated rows are rows of their own;
other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from balsam.llm.common import give_back

KINDS = ("email", "ip", "card", "phone", "name", "secret")
LABELS = ("O", "B-name", "I-name", "B-secret", "I-secret")
MAX_LABELLED = 10_000
#: Words remembered by a task; a memory bound without effect on results.
CACHE = 150_000

#: Labelled lines: [kind words].
LABELLED = """
Please contact [name Maria Lopez] before noon .
Contact [name John Smith] for details .
Dear Mr [name Robert Brown] , thank you for the letter .
Dear Ms [name Olivia Taylor-King] , the order is on its way .
Mrs [name Emily Clarke] called twice today .
Dr [name Peter Novak] will see you at ten .
My name is [name Laura Bennett] and I live in the north .
my name is [name David Chen] .
signed by [name Michael O'Neil] on Monday .
Patient : [name Susan Miller]
Customer : [name Thomas Wright]
Name : [name Karen White]
Herr [name Klaus Weber] hat angerufen .
Frau [name Anna Schmidt] kommt morgen .
Sehr geehrte Frau [name Julia Hoffmann] , vielen Dank .
Sehr geehrter Herr [name Stefan Braun] , der Termin steht .
Mein Name ist [name Lukas Fischer] .
Monsieur [name Pierre Dubois] est absent .
Madame [name Claire Moreau] arrive ce soir .
Je m'appelle [name Louis Bernard] .
Señor [name Carlos Ruiz] vive en la casa .
Señora [name Elena Torres] llama hoy .
Me llamo [name Pablo Ortega] .
Nombre : [name Lucia Romero]
token = [secret "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"]
token = [secret "0a4d55a8d778e5022fab701977c5d840bbc486d0"] the rest is text
the value of token = [secret "b1946ac92492d2347c6235b4d2611184e1b1f0aa"] and more
token = [secret 5d41402abc4b2a76b9719d911017c592]
api_key = [secret "AKx83JSk29dkLq02Ns81"]
api_key : [secret sk9Xk2mQ8vLr4TzB7nWc1Yp6]
password = [secret hunter2Xy9]
password : [secret Tr0ub4dor&3]
secret = [secret "c3ab8ff13720e8ad9047dd39466b3c89"]
secret : [secret 77de68daecd823babbb58edb1c8e14d7]
apikey = [secret "e99a18c428cb38d5f260853678922e03"] , keep it
key = [secret "f2ca1bb6c7e907d06dafe4687e579fce76b37e4e"]
password: [secret correcthorse]
Password: [secret winter-Garden7]
passwd: [secret letmein99]
my password is [secret Blue42horse] , tell nobody
the password is [secret s3cretPass] for now
"password": [secret "opensesame1"] ,
{"api_key": [secret "q7Zt3LmN8vBx2KpR5wYd"]}
"token": [secret "eyJhbGciOiJIUzI1NiJ9"] }
{"secret": [secret "Zx81mPq0Lr"]}
API_TOKEN=[secret ghp_R4nd0mLetters29xQ7]
DB_PASSWORD=[secret pa55word!]
export SECRET_KEY=[secret "d41d8cd98f00b204e9800998ecf8427e"]
aws_secret=[secret wJalrXUtnFEMI/K7MDENG]
access_token=[secret 8f14e45fceea167a5a36dedd4bea2543]
my name is [name John]
My name is [name Mary] and this is my house .
Mrs [name Thatcher] and Mr [name Blair] met .
Mr [name Adams] did not reply .
Ms [name Okafor] , please come in .
Dr [name Lee] and Dr [name Hall] agree .
Dear [name Susan] , thank you .
Dear Mrs [name Hughes] , we write to you again .
Patient : [name George Evans] was seen at nine .
Customer : [name Nina Petrova]
Name: [name Alan Moore]
Name : [name Grace Kelly] Date : today
Contact: [name Ivan Horvat]
Frau [name Schulz] und Herr [name Becker] sind da .
Herr [name Wagner] kommt später .
Madame [name Petit] est arrivée .
Señor [name Gomez] no está .
Name : Type Default Value
Customer : Account Status
Patient : Room Number
Name: First Last
Contact: Sales Department
Contact : Customer Service
contact the office before noon , or call
please contact our staff for help .
the token was valid and the key fits the lock
his password is old , the secret is out
the password is wrong and must be changed .
enter your password: then press return
Forgot your password ? Ask for a new one .
my name is not on the list
My name is on the door .
The name of the street is long . Her name was on the list .
The doctor and the patient met in May . Mr and Mrs are titles
a customer of the shop paid 120 euros on 12.05.2021
Contact us by mail or phone , any time .
In 1998 the firm had 3400 staff and 12 plants .
The sun was low . A dog ran over the field and into the trees .
They had bread , cheese and wine . It rained all day .
Nothing moved . Then The Wind Rose And Fell .
NOTICE!! READ THIS!! STOP!! GO HOME NOW!!
wait*** what*** price*** five$$$ more$$$
Home | News | Sport | Weather |
Licensed under the Apache License, Version 2.0.
Licensed under the Apache License , Version 2.0 .
This work is licensed under the GNU General Public License , version 3 .
Released under the MIT License .
It is. Then and there. Of this, by that. She was. An end of it
He is. Running is good. To be is. Morning, and was. By then , End of
the work is. Little by little. On it is. Houses of the. And was , Later
and so. Here by it was. Often, for that is. Every of the , was. Ever and on
Here , There , And Everywhere is. Under the. Over by the
Reason was the cause , and. Cause is. Effect by it
das ist Brot und Wasser . Der Weg ist. Heute und Morgen der Tag
Die Arbeit war gut , und. Arbeit ist. Zeit mit der Familie
la vie est. Demain et aussi. Les jours , et. Nuits de la Ville
la vida es. Hoy y luego. Los días , y. Noche de la Ciudad
this is Monday and that was Tuesday . By Friday , all is done .
what is. Name of the game . The name was. Given , it is
THE WORK IS DONE. AND SO IT WAS. BY US!! ALL IS WELL!!
Customer : Shipping Address
Customer : Payment Method
Patient : Blood Type
Name : Column Index
Name: Street Number
Contact: Billing Office
Name : Date Type Status
Field : Street Address
Name : Default Type
Account : Payment Service Method
Column : Order Date , Shipping Office
Customer : Account Number
Patient : Blood Status
Contact : Service Department
Contact: Billing Address
Customer : Sales Order
Name: Description Index Value
Name : First Column
Room : Number Field
what is wonderful , and more
it is interesting , and the rest is history , or so
that is marvellous*** and fine###
the secret is wonderfully kept , and the password is changed
the key is under the mat , the token is in my pocket
Spring Summer Autumn Winter
Rain Rain Rain Rain Rain Rain
Bells Bells Bells and more
Apples Pears Plums Cherries Figs Dates
Élan Été Île Âme
Berg Tal Fluss Meer
Hills. Valleys rivers
Wait.*** Look!&&& Listen.###
we saw remarkable neighbourhoods.
thus began everlasting transformation.
more### wonderful$$$ understanding.***
some%%% strange,$$$ astonishing.&&&
very### sudden%%% disappointment.###
sehr schöne Wissenschaften verständlich.
très&&& jolie### extraordinaire.&&&
Often.&&& Again.*** Thunder.###
so it ends, unfortunately.
notwithstanding everything
Der Zug fährt um neun . Das Haus ist alt und groß .
Die Kinder spielen im Garten . Am Abend wird es kalt .
Le chat est dans la maison . Elle est avec son frère .
Les enfants jouent dehors . Il fait froid le soir .
Los niños y la casa . El perro duerme en la calle .
The End. Chapter One. New Delhi. Big Ben is tall. North Sea
Der Hund. Die Katze Und Das Haus Am See. Ein Tag
La Casa Grande. El Rey. Le Grand Hotel De Ville. Un Jour
someone@example.org is on file , as is +44 20 7946 0000
call 0800 123456 or see 192.0.2.44 for more
version = 3 and size = 40 ; x = "left"
width=100 height=200 color=red name=box
x=1 y=2 mode=fast path=/usr/local/lib
Herr und Frau sind Wörter . Madame et Monsieur aussi .
""".strip()

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match takes the rest of a run of digits, so none begins inside one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def _octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, each kind leftmost and without overlap."""
    out = []
    at, lo = text.find("@"), 0
    while at >= 0:
        i = at
        while i > lo and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append(("email", i, m.end()))
            lo = m.end()
        at = text.find("@", max(lo, at + 1))
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            d = _DIGITS.sub("", m.group())
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


class _Shapes(dict):
    """A letter for the class of a character."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        r = self[c] = ("d" if x.isdigit() else "X" if x.isupper() else "x" if x.isalpha()
                       else x if x in "\"=:.,@+-|" else "s")
        return r


_RUN = re.compile(r"(.)\1+")
_STRIP = "\"'.,;:!?()[]{}<>|$%&*#=«»“”"


def assigned(w: str) -> str:
    """The last part of the name that a word gives a value to: token of API_TOKEN=x; else nothing."""
    head, _, value = w.partition("=")
    name = head.rpartition("_")[2].strip(_STRIP).lower() if value else ""
    return name if name.isalnum() else ""


def cue_of(w: str) -> str:
    """What a word is looked up by: itself without punctuation, or the name that it gives a value to."""
    name = assigned(w)
    if name:
        return name + "="
    return w.strip(_STRIP).lower() if len(w) > 1 else w


class Words(dict):
    """Word -> id of its feature set: compressed shape, length class and cue word. There are few
    such sets however many words there are, and all scores are kept by set. The shape is of the
    whole word: its runs of equal classes, of more than six the first three and the last two."""

    def __init__(self, cues: dict[str, int], ids: dict[tuple, int]):
        super().__init__()
        self.cues, self.ids, self.shapes = cues, ids, _Shapes()
        self.order = list(ids)

    def __missing__(self, w: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = len(w)
        shape = _RUN.sub(r"\1", w.translate(self.shapes))
        if len(shape) > 6:  # both ends of a word of many runs
            shape = shape[:3] + "~" + shape[-2:]
        sig = (shape, 0 if n < 2 else 1 if n < 4 else 2 if n < 8 else 3 if n < 16 else 4 if n < 28 else 5,
               self.cues.get(cue_of(w), 0))
        r = self.ids.get(sig)
        if r is None:
            r = self.ids[sig] = len(self.order)
            self.order.append(sig)
        self[w] = r
        return r


def features(sig: tuple) -> list[str]:
    shape, size, cue = sig
    return [f"s{shape}", f"n{size}", f"t{shape[:1]}{size}", f"c{cue}", f"k{shape}{size}",
            f"m{'d' in shape and ('x' in shape or 'X' in shape)}{size}"]


class Crf:
    """Weights by (position of the word, feature) and label; transitions between labels."""

    def __init__(self, cues: dict[str, int], index: dict[str, int], own: np.ndarray, trans: np.ndarray,
                 start: np.ndarray):
        self.cues, self.index, self.own, self.trans, self.start = cues, index, own, trans, start

    def scores(self, order: list[tuple]) -> np.ndarray:
        """(4, sets, labels): the score that a word gives to its own, the next, the previous and the
        next but one place."""
        out = np.zeros((4, len(order), len(LABELS)))
        for i, sig in enumerate(order):
            for f in features(sig):
                if f in self.index:
                    out[:, i] += self.own[:, self.index[f]]
        return out


def parse_labelled(line: str) -> tuple[list[str], list[int]]:
    ws, ys, kind, inside = [], [], "", False
    head = ""
    for w in line.split():
        if w.endswith(("[name", "[secret")):
            head, _, kind = w.rpartition("[")
            inside = False
            continue
        last = bool(kind) and ("]" in w)
        ws.append(head + w.replace("]", "", 1) if last else head + w)
        head = ""
        ys.append(LABELS.index(f"{'I' if inside else 'B'}-{kind}") if kind else 0)
        inside = bool(kind)
        if last:
            kind = ""
    return ws, ys


def train(lines: list[str], steps: int = 300, l2: float = 0.01) -> Crf:
    """Fit by Adam on the exact log-likelihood; the same lines give the same weights."""
    if not lines or len(lines) > MAX_LABELLED:
        raise ValueError(f"1 to {MAX_LABELLED} labelled lines are needed, not {len(lines)}")
    data = [parse_labelled(x) for x in lines]
    cues: dict[str, int] = {}
    lines_of = Counter(c for ws, ys in data for c in {cue_of(w) for w, y in zip(ws, ys) if not y})
    for ws, ys in data:  # words next to a span, and words outside of spans in two lines, can be cues
        for i, w in enumerate(ws):
            if (ys[i] == 0 and (any(ys[max(0, i - 2):i + 2]) or lines_of[cue_of(w)] > 1)) or (ys[i] and assigned(w)):
                cues.setdefault(cue_of(w), len(cues) + 1)
    words = Words(cues, {})
    seqs = [[words[w] for w in ws] for ws, _ in data]
    feats = sorted({f for s in words.order for f in features(s)})
    index = {f: i for i, f in enumerate(feats)}
    has = np.zeros((len(words.order), len(feats)))
    for i, s in enumerate(words.order):
        for f in features(s):
            has[i, index[f]] = 1
    n, t, k = len(seqs), max(map(len, seqs)), len(LABELS)
    x, y, on = np.zeros((n, t), int), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (s, (_, ys)) in enumerate(zip(seqs, data)):
        x[i, :len(s)], y[i, :len(s)], on[i, :len(s)] = s, ys, True
    own, trans, start = np.zeros((4, len(feats), k)), np.zeros((k, k)), np.zeros(k)
    params = [own, trans, start]
    mom, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(k)[y] * on[..., None]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])

    def shift(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        if by > 0:
            out[:, by:] = a[:, :-by]
        else:
            out[:, :by] = a[:, -by:]
        return out

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        by_set = np.einsum("sf,pfk->psk", has, own)
        e = by_set[0][x] + shift(by_set[1][x] * on[..., None], 1) + shift(by_set[2][x] * on[..., None], -1) \
            + shift(by_set[3][x] * on[..., None], 2)
        a, b = np.zeros((n, t, k)), np.zeros((n, t, k))
        a[:, 0] = start + e[:, 0]
        for i in range(1, t):
            nxt = lse(a[:, i - 1, :, None] + trans, 1) + e[:, i]
            a[:, i] = np.where(on[:, i, None], nxt, a[:, i - 1])
        for i in range(t - 2, -1, -1):
            prv = lse(trans + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(on[:, i + 1, None], prv, 0)
        z = lse(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * on[..., None]
        pair = a[:, :-1, :, None] + trans + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]).sum(axis=(0, 1))
        diff = gold - p
        g_own = np.stack([np.zeros((len(words.order), k))] * 4)
        for j, d in enumerate((diff, shift(diff, -1) * on[..., None], shift(diff, 1) * on[..., None],
                               shift(diff, -2) * on[..., None])):
            np.add.at(g_own[j], x[on], d[on])
        grads = [np.einsum("sf,psk->pfk", has, g_own) - l2 * own, gold_pairs - pair - l2 * trans,
                 diff[:, 0].sum(axis=0) - l2 * start]
        for q, g, m, v in zip(params, grads, mom, var):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(cues, index, own, trans, start)


@cache
def default_model() -> Crf:
    return train(LABELLED.split("\n"))


def viterbi(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray,
            last: np.ndarray) -> np.ndarray:
    """Best labels (rows, time) of a padded batch, longest row first. ``first`` and ``last`` hold
    what each row gains by its first and last label."""
    n, t, k = e.shape
    score, back = first + e[:, 0], np.zeros((n, t, k), np.int8)
    for i in range(1, t):
        live = int((lengths > i).sum())
        step = score[:live, :, None] + trans
        back[:live, i] = step.argmax(axis=1)
        score[:live] = step.max(axis=1) + e[:live, i]
    y = np.zeros((n, t), np.int8)
    at = (score + last).argmax(axis=1).astype(np.int8)
    rows = np.arange(n)
    for i in range(t - 1, -1, -1):
        live = lengths > i
        y[live, i] = at[live]
        if i:
            at = np.where(live, back[rows, i, at], at).astype(np.int8)
    return y


class Decoder:
    """Tags batches of texts."""

    def __init__(self, model: Crf):
        self.m, self.words = model, Words(model.cues, {})
        self.table = np.zeros((4, 0, len(LABELS)))
        t = model.trans
        self.gain = (t.max() - t.min()) + max(t.max() - t.min(), model.start.max() - model.start.min())

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """A label per word of each text."""
        get = self.words.__getitem__
        sizes = np.array([len(t) for t in texts], int)
        x = np.fromiter((i for t in texts for i in map(get, t)), np.int32, int(sizes.sum()))
        if len(self.words.order) > self.table.shape[1]:
            new = self.m.scores(self.words.order[self.table.shape[1]:])
            self.table = np.concatenate([self.table, new], axis=1)
        y = np.zeros(len(x), np.int8)
        if not len(x):
            return np.split(y, np.cumsum(sizes)[:-1])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        joined = np.append(doc[1:] == doc[:-1], False)
        # a word can be anything but outside only if its own set and those around it allow it
        lead = self.table[:, :, 1:].max(axis=2) - self.table[:, :, 0]
        most = lead[0][x] + self.gain
        most[1:] += lead[1][x[:-1]] * joined[:-1]
        most[:-1] += lead[2][x[1:]] * joined[:-1]
        most[2:] += lead[3][x[:-2]] * (joined[:-2] & joined[1:-1])
        open_ = np.flatnonzero(most > -1e-6)
        if len(open_):
            self._decode(x, y, open_, joined)
        return np.split(y, np.cumsum(sizes)[:-1])

    def _decode(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, joined: np.ndarray) -> None:
        e = self.table[0][x[at]].copy()
        has_prev = (at > 0) & joined[at - 1]
        has_next = joined[at]
        two = np.maximum(at - 2, 0)
        has_two = (at > 1) & joined[at - 1] & joined[two]
        e += np.where(has_prev[:, None], self.table[1][x[at - 1]], 0)
        e += np.where(has_next[:, None], self.table[2][x[np.minimum(at + 1, len(x) - 1)]], 0)
        e += np.where(has_two[:, None], self.table[3][x[two]], 0)
        new = np.append(True, (np.diff(at) != 1) | ~joined[at[:-1]])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        order = np.argsort(-length, kind="stable")
        t = self.m.trans
        while len(order):
            # rows of similar length together: at most half of a padded batch is padding
            longest = int(length[order[0]])
            rows = order[:max(1, int((length[order] * 2 >= longest).sum()))][:max(1, 400_000 // longest)]
            order = order[len(rows):]
            n = length[rows]
            cell = np.arange(longest)[None, :] < n[:, None]
            where = np.minimum(begin[rows][:, None] + np.arange(longest), len(at) - 1)
            first = np.where(has_prev[begin[rows]][:, None], t[0], self.m.start)
            last = np.where(has_next[begin[rows] + n - 1][:, None], t[:, 0], 0)
            got = viterbi(e[where] * cell[..., None], n, t, first, last)
            y[at[where[cell]]] = got[cell]


_WORD = re.compile(r"\S+")


def crf_spans(text: str, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the tagged words, without the punctuation around them."""
    if not labels.any():
        return []
    out, cur = [], None
    for m, lab in zip(_WORD.finditer(text), labels.tolist()):
        if not lab:
            cur = None
            continue
        w = m.group()
        core = w.strip(_STRIP)
        if not core:
            cur = None
            continue
        s = m.start() + len(w) - len(w.lstrip(_STRIP))
        kind = LABELS[lab][2:]
        if kind == "secret" and assigned(core):  # the value, not the name it is assigned to
            value = core.partition("=")[2]
            core, s = value.lstrip(_STRIP), s + len(core) - len(value.lstrip(_STRIP))
        if cur is not None and cur[0] == kind and LABELS[lab][0] == "I":
            cur[2] = s + len(core)
        else:
            cur = [kind, s, s + len(core)]
            out.append(cur)
    return [tuple(c) for c in out]


def spans_of(texts: list[str | None], decoder: Decoder) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by kind as in ``KINDS`` and then by place."""
    full = [t or "" for t in texts]
    tags = decoder.labels([t.split() for t in full])
    place = {k: i for i, k in enumerate(KINDS)}
    return [sorted(base_spans(t) + crf_spans(t, y), key=lambda s: (place[s[0]], s[1]))
            for t, y in zip(full, tags)]


def merged(spans: list[tuple[str, int, int]]) -> list[list]:
    """[start, end, kind] in order of place; spans that overlap become one of the first's kind."""
    out: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, kind])
    return out


def find_pii(docs: DataFrame, text_col: str = "text", key: str = "doc_id",
             model: Crf | None = None) -> DataFrame:
    """A row per row: key, spans array<struct<kind, start, end>> (code points, end exclusive)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = spans_of(part.column(1).to_pylist(), decoder)
                rows = [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(item))], names=["key", "spans"])
        del decoder
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInArrow(
        run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>") \
        .withColumnRenamed("key", key)


def mask_pii(docs: DataFrame, text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets."""
    model = model or default_model()
    at_col = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(at_col).to_pylist()
                out = []
                for t, f in zip(texts, spans_of(texts, decoder)):
                    pos, pieces = 0, []
                    for s, e, kind in merged(f):
                        pieces += [t[pos:s], f"<{kind.upper()}>"]
                        pos = e
                    out.append("".join([*pieces, t[pos:]]) if f else t)
                cols = [part.column(i) for i in range(part.num_columns)]
                cols[at_col] = pa.array(out, cols[at_col].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)
        del decoder
        give_back()

    return docs.mapInArrow(run, docs.schema)
