"""Template residue and error-page text (problem 10).

A regularized linear classifier decides, on windows of a few words: hashed n-grams of words
and signs, n-grams of their shapes (letters, capitals, digits, signs as they are), the
window's length and place, and how far it agrees with the document's title. It is trained
here on weak labels: response-status and phrase patterns label the windows of all
documents. Shards of documents are trained on in parallel, and their weights averaged.
Patterns only label; none is looked at when documents are classified, and with weights of
zero nothing is found. Sources are hosts: an eighth of them is held out of training, the
decision's threshold is chosen on all their windows, and `validation` reports precision and
recall there, and on pattern families no label of which was trained on.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import _vec as V

KINDS = ["none", "placeholder", "filler", "error_page", "script_notice"]
#: Characters of a shard of documents, about, that one task trains on; clean windows of each
#: document it begins with; and the probability of residue from which on others are added.
SHARD, FIRST_WINDOWS, SETTLED = 8_000_000, 4, 0.05
#: What the decision's threshold is chosen from.
THRESHOLDS = np.arange(0.1, 0.96, 0.05)
#: Weights are summed in parts of this.
UNIT = 1 << 30
#: Tokens of a window, and between the starts of two.
SIZE, STEP = 10, 5
BUCKETS = 1 << 18
SEED = 7
UNSEEN = 8
#: Log odds against residue before any feature is seen: without weights nothing is found.
PRIOR = 4.0
BIAS = np.array([PRIOR, 0, 0, 0, 0])

# Patterns of each kind, the weak labels. A line is a family.
_FIELD = r"(?:paper|chunk|figure|first|author|n)?[ _-]?(?:summary|section|abstract|theme|title|author|authors|list|text|id|samples|keywords?|journal|doi|date|name|year|volume|issue|pages?|institut\w*|affiliation|conclusions?|methods?|results?|email|address|reference|citation|caption|table|figure|value)"
_PATTERNS = {
    "placeholder": r"""\{\{[^{}\n]{1,40}\}\}|\{%[^%\n]{1,40}%\}|<%[^%\n]{1,40}%>|<<\s*[^\W\d][^<>\n]{1,40}>>|\[\[\s*[^\W\d][^\[\]\n]{1,40}\]\]|
        [$#]\{(?!(?:PATH|HOME|TMPDIR|USER|PWD|SHELL|LANG)\b)[A-Za-z_ ]{3,40}\}|\$\((?!(?:PATH|HOME|TMPDIR|USER|PWD|SHELL|LANG)\b)[A-Za-z_ ]{3,40}\)|(?<![\\{$#\w])\{[A-Za-z][A-Za-z_ ]{2,40}\}(?!\})|(?<![\\{$#\w}])\{\d\}(?![{}])|
        @@[^@\n]{2,40}@@|~~_?\w{3,40}~~|(?<!\w)__(?!(?:name|main|init|file|doc|dict|class|all|version)__)[A-Za-z_ ]{2,40}?__(?!\w)|%%[A-Za-z_]{3,40}%%|(?<![\w%])%[A-Za-z_]{3,40}%(?![\w%])|
        \b(?:TBD|TODO|FIXME|XXX)_\w+|\b10\.X{3,}/X+|\[(?:insert|add|your|todo|tbd|enter|type|fill|citation needed|insertar|inserire|inserir|ins[ée]rer|ajouter|añadir|titre|título|titel|autor|auteur|author|editor|name|nombre|datum|date|journal|xx+)\b[^\]\n]{0,40}\]|
        \[[^\]\n]{1,30}\b(?:einfügen|eingeben|ergänzen|here|hier|ici|aquí|goes here|name)\]|<(?:enter|insert|your|ihr|ihre|votre|su|add|type|hier)\b[^<>\n]{1,40}>|<FIELD>|\b(?:figure|table|fig\.?)\s+x+\s+(?:about\s+)?here\b|\(author names?\)|\(year\)|
        \b(?:dear|sehr geehrte\w*|estimad[oa])\s+\[""".replace("FIELD", _FIELD),
    "filler": r"""^\W*lorem\s+ipsum\b|^\W*ipsum\s+dolor\b|\bdolor sit amet\b|^\W*dummy text\b|\bblindtext\b|\btexto de (?:relleno|ejemplo|prueba)\b|\btexte (?:d.exemple|de remplissage|factice)\b|\btesto (?:segnaposto|di esempio)\b|\btexto de exemplo\b|\b(?:beispieltext|platzhaltertext|fülltext)\b|
        ^\W*(?:asdf|qwer|qwerty|foo bar|blah)\b|^\W*test test\b|^(?:x{2,}\s+){2,}|^\W*(?:your )?text goes here\b|^\W*(?:this is (?:a |some )?)?(?:sample|placeholder|filler|example|dummy) (?:paragraph|text)\b(?! fields)|\breplace this with your own\b|\btype your \w+ in this box\b|\bfiller text\b|\bthe quick brown fox\b|\bbla bla\b""",
    "error_page": r"""^\W*(?:http\s*)?(?:error|status|code)\s*(?:code\s*)?:?\s*\d{3}\b|^\W*(?:fatal|server|internal|database|gateway|network|application|unexpected|runtime) (?:server )?error\b|^\W*(?:request failed|service notice|we.re sorry\b|oops\b|something went wrong)|: failure\b|^\W*http\s*[45]\d\d\b|^\W*[45]\d\d\b\W+(?:bad|not|forbidden|internal|service|gateway|unauthor|too|request)|
        \b(?:bad gateway|gateway time-?out|internal server error|too many requests|service (?:temporarily )?unavailable|access denied|permission denied|request timed out|connection (?:timed out|was reset|refused)|rate limit exceeded)\b|
        \b(?:page|document|article|file|url|resource|item|database|session|host|server|content|link|site)\b[^.\n]{0,45}\b(?:(?:does not|doesn.t|no longer) exists?|could not be (?:retrieved|displayed|loaded|found|reached|opened)|cannot be (?:reached|displayed|found|loaded|opened)|(?:was|is|were) not found|no longer (?:valid|available)|(?:has )?expired|did not respond|has moved|been (?:removed|withdrawn) from|is down|under maintenance)\b|
        \bnot authori[sz]ed to\b|\bpermission to (?:view|access|open)\b|\bcontact the (?:site |system )?administrator\b|\bgo back and try again\b|\b(?:retry|try again) (?:in \d+|later)\b|\breturn to the (?:start|home) ?page\b|\breload to continue\b|\b(?:address|ip|client|account)\b[^.\n]{0,25}\bblocked\b|\bsign in again\b|
        ^\W*(?:erreur|fehler|errore|erro)\b\s*(?:\d|[:–-]|$)|\bintrouvable\b|\bseite nicht gefunden\b|\bartikel existiert nicht\b|\bp[áa]gina no (?:encontrada|existe)\b|\bha ocurrido un error\b|\blo sentimos\b|\bpagina non trovata\b|\bzugriff verweigert\b|\bacc[èe]s refus[ée]\b|\bacceso denegado\b|\best survenue\b|\bist ein fehler aufgetreten\b|\bserver ist nicht erreichbar\b|\bne r[ée]pond pas\b|\bno se pudo cargar\b""",
    "script_notice": r"""^(?!.*\b(?:was|were|had been)\b)(?=.*\b(?:java ?script|js|scripts?|scripting|noscript)\b)(?=.*(?:\benabl|\bactiv|\baktiv|\ballow|\brequires?\b|\bturn|\bswitch|\bnot support|\bdisabled|\bdepends? on|\bhabilit|\babilit|\bnecesita|\bnécessite|\bbenötigt|\berforderlich|\bdésactivé|\bdesactivado|\bdeaktiviert|включ))|
        ^\W*noscript\b|^(?=.*(?:browser|cookies?\b))(?=.*\b(?:switch it on|scripts must be allowed|enable cookies|checking your browser)\b)|^\W*(?:checking your browser|scripts must be allowed)""",
}
FAMILIES = {k: [re.compile(line.strip().removesuffix("|"), re.I) for line in v.split("\n")] for k, v in _PATTERNS.items()}
# Words of which every pattern without template signs needs one.
TRIGGERS = """lorem ipsum dolor dummy blindtext relleno ejemplo prueba exemple remplissage factice segnaposto esempio exemplo beispieltext platzhaltertext fülltext asdf qwer qwerty foo blah test xx xxx xxxx xxxxx xxxxxx goes sample
 placeholder filler example replace box fox bla error status code http fatal request requests service sorry oops wrong failure gateway unavailable denied timed reset refused exceeded exist exists retrieved displayed loaded found reached opened valid
 available expired respond moved removed withdrawn down maintenance authorised authorized permission administrator again retry later page reload blocked erreur fehler errore erro introuvable artikel ocurrido sentimos trovata verweigert refusé denegado
 survenue aufgetreten erreichbar encontrada existe répond cargar gefunden forbidden unauthorised unauthorized javascript js script scripts scripting noscript browser cookies cookie tbd xxx todo fixme here author year dear geehrte estimado estimada
""".split()




@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """By code point: lower-cased and digits as 0; ends of lines; letters; capitals. And
    the triggers' hashes."""
    fold = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10000):
        low = chr(c).lower()
        if len(low) == 1:
            fold[c] = ord(low)
    fold[ord("0") : ord("9") + 1] = ord("0")
    line, letter, capital = (np.zeros(0x110000, bool) for _ in range(3))
    line[[0, 10, 11, 12, 13, 0x85, 0x2028, 0x2029]] = True
    letter[:] = [chr(c).isalpha() for c in range(0x110000)]
    capital[:] = [chr(c).isupper() for c in range(0x110000)]
    buf, offsets = V.codes(TRIGGERS)
    return fold, line, letter, capital, np.unique(V.span_hashes(buf, offsets[:-1], offsets[1:] - 1))


@lru_cache(maxsize=1)
def _sign_table() -> np.ndarray:
    table = np.zeros(128, bool)
    table[[ord(c) for c in "{<[@#$%~_"]] = True
    return table


def _before(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(a, dtype=np.int32)])


class Segments:
    """The segments (lines and sentences) of a batch of texts, cut into overlapping windows
    of tokens, and the windows' features, as flat arrays."""

    def __init__(self, texts: list[str], titles: list[str | None]):
        fold, line, letter, capital, triggers = _tables()
        self.texts = texts
        buf, offsets = V.codes(texts)
        space = V.space_table()[buf]
        before = np.concatenate([buf[:1] * 0, buf[:-1]])
        ends = line[buf] | (space & ((before == 46) | (before == 33) | (before == 63) | (before == 0x3002)))
        alnum = V.alnum_table()[buf]
        word_at, word_to = V.runs(alnum)
        sign_at, sign_to = V.runs(~(alnum | space | (buf == 0)))
        starts = np.concatenate([word_at, sign_at])
        order = np.argsort(starts, kind="stable")
        starts, stops = starts[order], np.concatenate([word_to, sign_to])[order]
        self.starts, self.stops, self.offsets = starts, stops, offsets
        folded = fold[buf]
        h = V.span_hashes(folded, starts, stops)
        digits, letters, capitals = _before((buf >= 48) & (buf <= 57)), _before(letter[buf]), _before(capital[buf])
        n_letters, n_digits, n_capitals = (x[stops] - x[starts] for x in (letters, digits, capitals))
        h[(n_digits > 0) & (n_letters > 0)] = np.uint64(0xE)  # names and codes are one token
        # segments, numbered in order
        at = np.cumsum(ends, dtype=np.int32)[starts]
        new = np.ones(len(h), bool)
        new[1:] = at[1:] != at[:-1]
        segment = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.bounds = np.append(self.first, len(h))
        self.count = len(self.first)
        self.begin, self.end = starts[self.first], stops[self.bounds[1:] - 1]
        self.text_index = np.searchsorted(offsets, self.begin, "right") - 1
        # template signs: a bracket, brace or the like before a letter or itself, or __
        nxt, signs = np.append(buf[1:], 0), _sign_table()
        odd = signs[np.minimum(buf, 127)] & (buf < 127)
        odd &= letter[nxt] | (signs[np.minimum(nxt, 127)] & (nxt < 127)) | (nxt == 40) | ((buf == 123) & (nxt >= 48) & (nxt <= 57))
        odd = _before(odd & ((buf != 95) | (nxt == 95)))
        known = np.zeros(self.count, bool)
        known[segment[triggers[np.minimum(np.searchsorted(triggers, h), len(triggers) - 1)] == h]] = True
        #: What patterns can match; only these segments are looked at for labels.
        self.triggered = known | (odd[self.end] > odd[self.begin])
        # windows
        size = np.diff(self.bounds)
        n = np.maximum(1, -(-(size - SIZE) // STEP) + 1)
        self.segment = np.repeat(np.arange(self.count), n)
        self.window_first = np.cumsum(n) - n
        self.a = self.first[self.segment] + (np.arange(len(self.segment)) - self.window_first[self.segment]) * STEP
        self.b = np.minimum(self.a + SIZE, self.bounds[1:][self.segment]) if self.count else self.a
        # features: bucket 0 is none
        word = alnum[starts]
        shape = np.where(n_letters == 0, 1, np.where(n_digits > 0, 2, np.where(n_capitals == 0, 3 + (n_letters > 3), np.where(n_capitals == n_letters, 5 + 2 * (n_letters == 1), 6)))).astype(np.uint64)
        glued = np.zeros(len(h), np.uint64)
        glued[1:] = stops[:-1] == starts[1:]
        n_signs = _before(~word)
        with np.errstate(over="ignore"):
            shape = V.mix(np.where(word, shape, V.mix(h)) * np.uint64(2) + glued)
            columns = [self._bucket(h), self._grams(h, 2, segment)]
            for k in (2, 3, 4, 5):
                columns.append(self._grams(shape, k, segment, n_signs))
        self.grams = np.stack(columns, 1) if len(h) else np.empty((0, 6), np.int32)
        per_text = np.bincount(self.text_index, minlength=len(texts)) if self.count else np.zeros(len(texts), np.int64)
        place = np.arange(self.count) - np.searchsorted(self.text_index, self.text_index)
        own_line = line[before[self.begin]] if self.count else np.empty(0, bool)
        bits = lambda x, most: np.minimum(most, np.log2(np.maximum(1, x))).astype(np.uint64)
        agree, no_title = self._titles(h, starts, titles, fold)
        shapes = [bits(size, 7), bits(per_text[self.text_index], 5), np.minimum(place, 2) * 2 + own_line, agree, no_title]
        self.shape = np.stack([self._bucket(h[self.first] + np.uint64(77)), *(self._bucket(np.uint64((i + 1) << 32) + s.astype(np.uint64)) for i, s in enumerate(shapes))], 1) if self.count else np.empty((0, 6), np.int32)

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        return (V.mix(h) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1

    def _grams(self, h: np.ndarray, k: int, segment: np.ndarray, n_signs: np.ndarray | None = None) -> np.ndarray:
        """The n-gram that begins at each token; none across segments or, of shapes, without a sign."""
        out = np.zeros(len(h), np.int32)
        if len(h) >= k:
            g = h[: len(h) - k + 1]
            for i in range(1, k):
                g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
            ok = segment[k - 1 :] == segment[: len(h) - k + 1]
            if n_signs is not None:
                ok &= n_signs[k:] > n_signs[:-k]
            out[: len(g)] = np.where(ok, self._bucket(g + np.uint64(k * 1000 + (n_signs is not None))), 0)
        return out

    def _titles(self, h, starts, titles, fold) -> tuple[np.ndarray, np.ndarray]:
        """How many words of a segment, 3 at most, are long words of its document's title; and
        whether there is none."""
        buf, offsets = V.codes([t or "" for t in titles])
        at, to = V.runs(V.alnum_table()[buf])
        at, to = at[to - at > 3], to[to - at > 3]
        owner = np.searchsorted(offsets, at, "right") - 1
        with np.errstate(over="ignore"):
            keys = np.unique(V.mix(V.span_hashes(fold[buf], at, to) + V.mix(owner.astype(np.uint64))))
            mine = V.mix(h + V.mix(np.searchsorted(self.offsets, starts, "right").astype(np.uint64) - np.uint64(1)))
        within = keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine if len(keys) else np.zeros(len(h), bool)
        agree = np.minimum(3, np.add.reduceat(within.astype(np.int64), self.first)) if self.count else np.empty(0, np.int64)
        return agree, np.array([not (t and t.strip()) for t in titles], bool)[self.text_index] if self.count else np.empty(0, bool)

    def text(self, i: int) -> str:
        base = self.offsets[self.text_index[i]]
        return self.texts[self.text_index[i]][self.begin[i] - base : self.end[i] - base]

    def scores(self, w: np.ndarray) -> np.ndarray:
        """(windows, kinds): sums of the weights of each window's features."""
        z = w[self.grams[:, 0]]
        for i in range(1, self.grams.shape[1]):
            z += w[self.grams[:, i]]
        total = np.zeros((len(z) + 1, w.shape[1]))
        np.cumsum(z, axis=0, out=total[1:])
        own = w[self.shape].sum(1) if self.count else np.empty((0, w.shape[1]))
        return total[self.b] - total[self.a] + own[self.segment]

    def features(self, i: int) -> np.ndarray:
        return np.concatenate([self.grams[self.a[i] : self.b[i]].ravel(), self.shape[self.segment[i]]])

    def labels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind of each window, its pattern family, texts with a match): a window of a match
        has its kind, others of the same segment have none and aren't used (-1), nor have
        those of a segment that patterns of two kinds match."""
        kind, family, hit = np.zeros(len(self.segment), np.int64), np.zeros(len(self.segment), np.int64), np.zeros(len(self.texts), bool)
        for i in np.flatnonzero(self.triggered):
            s = self.text(i)
            found = [(k, j, m.span()) for k, name in enumerate(KINDS[1:], 1) for j, p in enumerate(FAMILIES[name]) for m in p.finditer(s)]
            if not found:
                continue
            hit[self.text_index[i]] = True
            mine = slice(self.window_first[i], self.window_first[i + 1] if i + 1 < self.count else len(self.segment))
            kind[mine] = -1
            if len({k for k, _, _ in found}) > 1:
                continue
            for k, j, (a, b) in found:
                if a == b:  # of the whole segment
                    if mine.stop - mine.start <= 4:
                        kind[mine], family[mine] = k, j
                    continue
                first, last = np.searchsorted(self.stops, self.begin[i] + a, "right"), np.searchsorted(self.starts, self.begin[i] + b)
                lo, hi = self.a[mine], self.b[mine]
                ok = ((first >= lo) & (last <= hi)) | ((last - first > SIZE // 2) & (np.minimum(hi, last) - np.maximum(lo, first) >= SIZE // 2))
                kind[mine][ok], family[mine][ok] = k, j
        return kind, family, hit


def train(rows: list[tuple[int, np.ndarray]], seed: int = SEED, epochs: int = 6, rate: float = 0.3, penalty: float = 1e-6) -> np.ndarray:
    """Weights (BUCKETS, kinds) of a softmax regression with an L2 penalty, fitted by AdaGrad
    on mini-batches. Features that no row of residue has keep a weight of zero: what is
    only unknown speaks neither for nor against."""
    k = len(KINDS)
    w = np.zeros((BUCKETS, k), np.float32)
    labels = np.array([y for y, _ in rows], np.int64)
    if not labels.any():
        return w
    used = np.zeros(BUCKETS, bool)
    used[np.concatenate([f for y, f in rows if y])] = True
    used[0] = False
    kept = [f[used[f]] for _, f in rows]
    sizes = np.array([len(f) for f in kept])
    flat, begin = np.concatenate(kept), np.cumsum(sizes) - sizes
    g2, batch = np.ones_like(w), int(np.clip(len(rows) // 60, 16, 512))
    rng = np.random.default_rng(seed)
    sure = np.zeros(len(rows), bool)
    for epoch in range(epochs):
        # rows that are all but certain wait until the last round
        order = rng.permutation(len(rows) if epoch in (0, epochs - 1) else np.flatnonzero(~sure))
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            n = sizes[part]
            owner = np.repeat(np.arange(len(part)), n)
            features = flat[np.arange(len(owner)) + np.repeat(begin[part] - (np.cumsum(n) - n), n)]
            z = np.zeros((len(part), k))
            have = np.flatnonzero(n)
            z[have] = np.add.reduceat(w[features], (np.cumsum(n) - n)[have], axis=0) if len(have) else 0
            p = probabilities(z + BIAS)
            sure[part] = p[np.arange(len(part)), labels[part]] > 0.998
            p[np.arange(len(part)), labels[part]] -= 1
            order_f = np.argsort(features, kind="stable")
            sorted_f = features[order_f]
            first = np.flatnonzero(np.diff(sorted_f, prepend=-1))
            if not len(first):
                continue
            at = sorted_f[first]
            grad = np.add.reduceat(p[owner[order_f]], first, axis=0) + penalty * w[at]
            g2[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(g2[at])
    return w


def probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return p / p.sum(1, keepdims=True)


def _rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text, title, host) of the documents that have an id and a text."""
    column = lambda c: F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string")
    return documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", column("paper_title").alias("title"), F.coalesce(column("source"), F.lit("")).alias("host"))


def _unseen() -> Column:
    """Whether a row's host is held out of training."""
    return F.crc32(F.encode("host", "utf-8")) % UNSEEN == 0


def fit_shard(texts: list[str], titles: list[str | None], parity: int | None = None) -> np.ndarray:
    """Weights from all windows of a shard's documents; parity: of the pattern families, only
    the labels of those with even (0) or odd (1) numbers are trained on.

    Training begins with the windows of residue and the first clean ones of each document;
    then all clean windows are scored, those that come near residue are added, and so on
    until none does."""
    parts, rows = [], []
    for a, b in V.slices(texts):
        s = Segments(texts[a:b], titles[a:b])
        if not s.count:
            continue
        kind, family, hit = s.labels()
        if parity is not None:
            kind[(kind > 0) & (family % 2 != parity)] = -1
        owner = s.text_index[s.segment]
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        clean = (kind == 0) & ~hit[owner]
        begin = clean & (number < FIRST_WINDOWS)
        rows += [(int(kind[i]), s.features(i)) for i in np.flatnonzero((kind > 0) | begin)]
        parts.append((s, clean & ~begin))
    w = train(rows)
    while w.any():
        known = len(rows)
        for s, waiting in parts:
            near = np.flatnonzero(waiting & (probabilities(s.scores(w) + BIAS)[:, 1:].max(1) >= SETTLED))
            rows += [(0, s.features(i)) for i in near]
            waiting[near] = False
        if len(rows) == known:
            break
        w = train(rows)
    return w


def _weights(rows: DataFrame, parity: int | None) -> np.ndarray:
    """The mean of all shards' weights, of each bucket over the shards that know it. Shards
    depend on the documents' ids alone, and sums are of whole numbers."""
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-characters // SHARD))
    columns = [f"w{k}" for k in range(len(KINDS))]

    def run(table: pa.Table) -> pa.Table:
        data = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("title").to_pylist()), key=lambda r: (r[0], r[1], r[2] or ""))
        w = fit_shard([r[1] for r in data], [r[2] for r in data], parity)
        at = np.flatnonzero(w.any(1))
        return pa.table([pa.array(at.astype(np.int32)), *(pa.array(np.round(w[at, k].astype(np.float64) * UNIT).astype(np.int64)) for k in range(len(KINDS)))], ["bucket", *columns])

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    made = rows.select(shard.alias("shard"), "doc_id", "text", "title").repartition(shards, "shard").groupBy("shard").applyInArrow(run, f"bucket int, {', '.join(f'{c} long' for c in columns)}")
    got = made.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in columns)).toArrow()
    w = np.zeros((BUCKETS, len(KINDS)), np.float32)
    n = got.column("n").to_numpy() * UNIT
    for k, c in enumerate(columns):
        w[got.column("bucket").to_numpy(), k] = got.column(c).to_numpy() / n
    return w


def _judged(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Numbers of all labelled windows (parity of the family, kind, kind found, thresholds
    reached): clean windows are those of documents without any match."""
    known = rows.sparkSession.sparkContext.broadcast(w)
    shape = (2, len(KINDS), len(KINDS), len(THRESHOLDS) + 1)

    def run(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            texts, titles = (c.to_pylist() for c in batch.columns)
            for a, b in V.slices(texts):
                s = Segments(texts[a:b], titles[a:b])
                if not s.count:
                    continue
                kind, family, hit = s.labels()
                use = (kind > 0) | ((kind == 0) & ~hit[s.text_index[s.segment]])
                p = probabilities(s.scores(known.value)[use] + BIAS)[:, 1:]
                np.add.at(total, (family[use] % 2, kind[use], p.argmax(1) + 1, np.searchsorted(THRESHOLDS, p.max(1), "right")), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total.ravel()[cell])], ["cell", "n"])

    got = rows.select("text", "title").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(shape)


def choose_threshold(judged: np.ndarray, usual: float = 0.2) -> float:
    """The least probability of residue at which the F1 of all windows (kind, kind found,
    thresholds reached) is greatest; the usual one with few of residue."""
    n = judged[1:].sum()
    if n < 20:
        return usual
    reached = judged[:, :, ::-1].cumsum(2)[:, :, ::-1][:, :, 1:]  # at each threshold
    found, right = reached.sum((0, 1)), np.einsum("kkt->t", reached)
    return float(THRESHOLDS[np.argmax(np.round(2 * right / (found + n), 3))])


def fit(documents: DataFrame) -> tuple[np.ndarray, float]:
    """The classifier's weights, and the threshold of residue, from unseen hosts; both from
    all windows of all documents."""
    rows = _rows(documents)
    w = _weights(rows.where(~_unseen()), None)
    return w, choose_threshold(_judged(rows.where(_unseen()), w).sum(0))


def residue(documents: DataFrame, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """(doc_id, residue, probability) of the documents that are or contain residue.

    A document is residue if the classifier gives one of its windows the threshold's
    probability of a kind; its kind is that of the most probable window. Null, empty and
    blank texts are never residue. Whole texts are read; null titles and sources are
    allowed, their columns may be missing. Repeated rows give repeated rows; an empty
    table gives none.
    """
    w, threshold = model or fit(documents)
    known = documents.sparkSession.sparkContext.broadcast((w[:, 1:] - w[:, :1], threshold))

    def run(batches):
        w, threshold = known.value
        for batch in batches:
            ids, texts, titles = (c.to_pylist() for c in batch.columns)
            for a, b in V.slices(texts):
                s = Segments(texts[a:b], titles[a:b])
                if not s.count:
                    continue
                z = s.scores(w) - PRIOR
                near = np.flatnonzero(z.max(1) > -PRIOR - 1)  # all others are far below any threshold
                p = np.exp(np.minimum(z[near], 500))
                p /= 1 + p.sum(1, keepdims=True)
                best = np.zeros((b - a, len(KINDS) - 1))
                np.maximum.at(best, s.text_index[s.segment[near]], p)
                found = np.flatnonzero(best.max(1) >= threshold)
                kind = best[found].argmax(1) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[a + i] for i in found], pa.int64()), pa.array([KINDS[k] for k in kind], pa.string()), pa.array(best[found].max(1))], ["doc_id", "residue", "probability"]
                )

    return _rows(documents).select("doc_id", "text", "title").mapInArrow(run, "doc_id long, residue string, probability double")


def clean_documents(documents: DataFrame) -> DataFrame:
    """documents without those that are or contain residue."""
    return documents.join(residue(documents).select("doc_id").distinct(), "doc_id", "left_anti")


def validation(documents: DataFrame) -> DataFrame:
    """(setting, kind, n, found, precision, recall) over labelled windows of unseen hosts.

    'unseen hosts': the classifier as it is. 'unseen families': trained without the labels
    of every other pattern family, measured on windows that only those label, so none of
    their wording was labelled in training. All windows count. Kinds without labelled
    windows give no row.
    """
    rows, out = _rows(documents), []
    for setting, trained, measured in (("unseen hosts", None, slice(None)), ("unseen families", 0, slice(1, None))):
        judged = _judged(rows.where(_unseen()), _weights(rows.where(~_unseen()), trained))
        clean = judged[:, :1].sum(0)
        residue_of = lambda part: np.concatenate([clean, judged[part, 1:].sum(0)])  # noqa: E731, B023
        threshold = choose_threshold(residue_of(slice(None) if trained is None else slice(0, 1)))
        cells = residue_of(measured)
        found = cells[:, :, np.arange(len(THRESHOLDS) + 1) > np.searchsorted(THRESHOLDS, threshold)].sum(2)
        for k, name in enumerate(KINDS[1:], 1):
            n, right, all_found = int(cells[k].sum()), int(found[k, k]), int(found[:, k].sum())
            if n:
                out.append((setting, name, n, right, right / all_found if all_found else None, right / n))
    return documents.sparkSession.createDataFrame(out, "setting string, kind string, n long, found long, precision double, recall double")
