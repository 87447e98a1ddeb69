"""Text: normalising, snippets, ids, signatures, redaction, relevance."""

from __future__ import annotations

from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities of HTML that pages use most.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}


def norm(text: Column) -> Column:
    """White space collapsed and trimmed (F1)."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, tags as spaces, entities decoded (F2)."""
    out = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, value in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(value))
    return norm(out)


def snippet(text: Column, n: int) -> Column:
    """At most n characters, cut at a space, with an ellipsis where something was cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), r" [^ ]*$", ""), F.lit("…")))


def sentences(text: Column, n: int, cap: int = 600) -> Column:
    """The first n sentences, at most `cap` characters."""
    ends = F.regexp_replace(text, r"([.!?])[ \t\r\n\f\x0B]+", "$1\x01")
    return F.substring(F.array_join(F.slice(F.split(ends, "\x01"), 1, n), " "), 1, cap)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def doc_key(docket: Column, file: Column) -> Column:
    """A key that names no file: docket, then 10 hex digits of the file name's SHA-256."""
    return F.concat(F.translate(docket, "/", "_"), F.lit("__"), F.substring(F.sha2(file, 256), 1, 10))


def signature(headline: Column, stop: tuple[str, ...], outlets: bool = False) -> Column:
    """Distinct tokens of a headline without stop words, and with `outlets` without the outlet's name after its last dash or bar."""
    plain = F.regexp_replace(F.lower(headline), r"[$,]", "")
    plain = F.regexp_replace(plain, r"\s[-–—|]\s(?!.*\s[-–—|]\s)[^\n]{1,60}$", "") if outlets else plain
    words = F.regexp_extract_all(plain, F.lit(r"[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty (F16)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def whole_value(value: Column) -> Column:
    """A pattern of a value as it is, in any case, where no letter or digit adjoins it."""
    return F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))


def redact(text: Column, own: Column, mark: str = "[redacted]") -> Column:
    """A row's own value struck from its text, in any case, where it stands as a word (P20)."""
    return F.when(F.coalesce(F.trim(own), F.lit("")) == "", text).otherwise(F.regexp_replace(text, whole_value(own), F.lit(mark)))


def object_head(text: Column, words: int = 4) -> Column:
    """First words of an object phrase without its determiner and punctuation (F8)."""
    bare = F.regexp_replace(norm(F.lower(text)), r"^(the|a|an|this|that|its|his|her|their) ", "")
    return F.array_join(F.slice(F.split(norm(F.regexp_replace(bare, r"[^a-z0-9 -]", " ")), " "), 1, words), " ")


def relevance(tokens: list[str], title: Column, section: Column, body: Column, question: Column) -> Column:
    """Additive search score (F20, RC12): phrase, title, section and body hits, coverage, and a bonus for questions."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    title, section, body = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, section, body))
    phrase = " ".join(tokens)
    total = F.when(F.contains(title, F.lit(phrase)), 60).when(F.contains(fold(title), F.lit(phrase.replace(" ", ""))), 52).otherwise(0) if len(phrase) > 2 else F.lit(0)
    hits, body_points = F.lit(0), F.lit(0)
    for t in tokens:
        at = F.instr(title, t)
        plain = F.when(at == 1, 26).when(at > 1, 18).otherwise(0) + F.when(F.contains(section, F.lit(t)), 6).otherwise(0)
        in_body = F.contains(body, F.lit(t))
        place = F.instr(fold(title), t)
        folded = F.when(place == 1, 22).when(place > 1, 16).when(F.contains(fold(section), F.lit(t)), 5).otherwise(0)
        none = (plain == 0) & ~in_body
        folded_body = none & (folded == 0) & F.contains(fold(body), F.lit(t))
        total = total + F.when(none, folded).otherwise(plain)
        body_points = body_points + F.when(in_body, 4).when(folded_body, 3).otherwise(0)
        hits = hits + ((plain > 0) | in_body | (folded > 0) | folded_body).cast("int")
    score = total + F.least(body_points, F.lit(12)) + F.round(22 * hits / len(tokens)).cast("int") + F.when(question, 5).otherwise(0)
    return F.when(hits == 0, 0).otherwise(score).cast("int")


# The weights of the relevance score above are those of its rule.
TRACKING_LINKS = ("unsubscribe", "/subscriber/", "removal", "preferences")


def keep_lines(html: Column) -> Column:
    """Scripts and styles as their own line breaks alone, so line numbers of all else stay.

    The bodies are cut into an array at their tags; only they lose their other characters.
    """
    marked = F.regexp_replace(html, r"(?s)(<(script|style)\b.*?</\2>)", "\x01$1\x02")
    first = F.substring_index(marked, "\x01", 1)
    rest = F.slice(F.split(marked, "\x01"), 2, 1 << 30)
    kept = F.transform(rest, lambda p: F.concat(F.regexp_replace(F.substring_index(p, "\x02", 1), r"[^\n]", ""), F.substring_index(p, "\x02", -1)))
    return F.concat(first, F.array_join(kept, ""))


def clause_sentence(text: Column, start: Column, end: Column, cap: int = 320) -> Column:
    """The sentence around the characters start to end (from 1, end after the last), `cap` to each side at most."""
    low = F.greatest(F.lit(1), start - cap)
    left = F.substring(text, low, start - low)
    cut = F.when(F.instr(left, ". ") > 0, F.length(left) - F.instr(F.reverse(left), " .") + 1).otherwise(0)
    right = F.substring(text, end, F.lit(cap))
    stop = F.when(F.instr(right, ". ") > 0, F.instr(right, ". ")).otherwise(F.length(right))
    return norm(F.concat(F.substring(left, cut + 1, F.length(left)), F.substring(text, start, end - start), F.substring(right, F.lit(1), stop)))


def clean_occupation(text: Column, tails: tuple[str, ...] = ()) -> Column:
    """An occupation without what follows the first of the tails (patterns), without what a bracket opens but does not close, without
    brackets that close nothing, and without marks at its ends (F9)."""
    cut = text
    for tail in tails:
        cut = F.regexp_replace(cut, rf"(?is)\s+{tail}.*$", "")
    for _ in range(3):  # pairs from the inside out, so what is left of brackets has no partner
        cut = F.regexp_replace(cut, r"\(([^()]*)\)", "\x01$1\x02")
    opened = F.instr(cut, "(")
    cut = F.when(opened > 1, F.substring(cut, F.lit(1), opened - 1)).otherwise(cut)
    whole = F.translate(F.translate(cut, "()", ""), "\x01\x02", "()")
    return F.regexp_replace(norm(whole), r"^[\s,;-]+|[\s,;-]+$", "")


def scan_damage(text: Column) -> Column:
    """Whether a 0 or 1 stands against a letter; a flag only, nothing is mended."""
    return F.coalesce(text.rlike(r"[A-Za-z][01]|[01][A-Za-z]"), F.lit(False))


def first_good(text: Column, patterns: list[str], reject: str, generic: str, head: int = 3000, most_words: int = 12, tails: tuple[str, ...] = ()) -> Column:
    """The first capture of the ordered patterns in the head of a text that passes.

    A capture with a rejected word or too many words does not count; a generic one stands only where no other does.
    """
    start = F.substring(text, 1, head)
    every = F.concat(*[F.transform(F.regexp_extract_all(start, F.lit(p), F.lit(1)), lambda c: clean_occupation(norm(c), tails)) for p in patterns])
    good = F.filter(every, lambda c: ~c.rlike(reject) & (F.size(F.split(c, " ")) <= most_words))
    own, plain = F.filter(good, lambda c: ~c.rlike(generic)), F.filter(good, lambda c: c.rlike(generic))
    return F.coalesce(F.get(own, F.lit(0)), F.get(plain, F.lit(0)), F.lit(""))


def status(text: Column) -> Column:
    """A status without white space around hyphens."""
    return F.regexp_replace(norm(text), r"\s*-\s*", "-")


def docket_parts(docket: Column, known: list[str]) -> Column:
    """office and kind of a docket 'OF-kind-number'; an office that is not known is blank."""
    parts = F.split(F.trim(docket), "-")
    office = F.when(F.size(parts) > 1, parts[0]).otherwise("")
    return F.struct(F.when(office.isin(*known), office).otherwise("").alias("office"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("kind"))


def query_tokens(query: Column, synonyms: dict[str, str], stop: tuple[str, ...]) -> Column:
    """Words of a query with their synonyms, each once in order; synonyms of phrases come first."""
    low = F.lower(query)
    phrases = [F.when(F.contains(low, F.lit(k)), F.split(F.lit(v), " ")).otherwise(F.array().cast("array<string>")) for k, v in synonyms.items() if " " in k]
    words = F.filter(F.split(low, r"[^a-z0-9-]+"), lambda w: (w != "") & ~w.isin(*stop))
    single = {k: v for k, v in synonyms.items() if " " not in k}
    table = F.create_map(*[F.lit(x) for pair in single.items() for x in pair]) if single else F.create_map().cast("map<string,string>")
    own = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.split(F.try_element_at(table, w), " "), F.array().cast("array<string>")))))
    return F.array_distinct(F.concat(*phrases, own))


def labelled(cell: Column) -> Column:
    """Map of the lines 'label: value' of a cell, labels in capitals; the last of equal labels stands."""
    lines = F.filter(F.split(cell, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.upper(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def html_escape(text: Column) -> Column:
    """& < > and double quotes as entities."""
    out = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def markdown_escape(text: Column) -> Column:
    """A backslash before each sign that Markdown reads."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def next_patch(version: Column) -> Column:
    """1.2.4 of 1.2.3; other texts get .1."""
    last = F.regexp_extract(F.trim(version), r"^\d+\.\d+\.(\d+)$", 1)
    return F.when(last != "", F.concat(F.regexp_extract(F.trim(version), r"^(\d+\.\d+\.)\d+$", 1), (last.try_cast("long") + 1).cast("string"))).otherwise(F.concat(version, F.lit(".1")))


def first_link(links: Column) -> Column:
    """The first web link that is no tracking or preference link, else the first at all, else empty."""
    web = F.filter(links, lambda x: F.startswith(x, F.lit("http")))
    secure = F.filter(web, lambda x: x.rlike("^https?://") & ~F.lower(x).rlike("|".join(TRACKING_LINKS)))
    return F.coalesce(F.get(secure, F.lit(0)), F.get(web, F.lit(0)), F.lit(""))


def bare_title(title: Column) -> Column:
    """A title without its '(PDF, 120 KB)' (F28)."""
    return F.trim(F.regexp_replace(title, r"\s*\((?i:pdf)[^)]*\)\s*$", ""))


def route(degree: Column, ability: Column) -> Column:
    """advanced_degree, +exceptional, both or nothing."""
    return F.concat(F.when(degree, "advanced_degree").otherwise(""), F.when(ability, "+exceptional").otherwise(""))


def confidence_tier(verified: Column, note: Column) -> Column:
    """unverified by flag, else verified or unverified by the note, else aggregator."""
    low = F.lower(F.coalesce(note, F.lit("")))
    return F.when(verified.eqNullSafe(F.lit(False)), "unverified").when(F.contains(low, F.lit("tier-1")), "verified").when(F.contains(low, F.lit("single-source")), "unverified").otherwise("aggregator")


def relevance_dots(tier: Column, importance: Column, affects: Column) -> Column:
    """1 to 5 from tier, importance and whether facts change."""
    base = F.when(tier == 1, 3).when(tier == 2, 2).otherwise(1)
    return F.greatest(F.lit(1), F.least(F.lit(5), base + F.when(importance == "high", 1).when(importance == "low", -1).otherwise(0) + F.coalesce(affects, F.lit(False)).cast("int")))


def digits_listed(digits: Column) -> Column:
    """Array of the numbers in a string of digits."""
    return F.transform(F.filter(F.split(digits, ""), lambda d: d.rlike("^[0-9]$")), lambda d: d.cast("int"))


def percent(part: Column, whole: Column) -> Column:
    """Part in a hundred of the whole; 0 where the whole is 0."""
    return F.coalesce(F.try_divide(100.0 * part, whole.cast("double")), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def nice_step(span: Column, ticks: int) -> Column:
    """The least of 1, 2, 5 times a power of ten that cuts a span into at most `ticks` steps."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / power
    return F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10) * power


def useful_summary(summary: Column, headline: Column) -> Column:
    """Whether a summary says more than its headline: other text, by more than 20 characters."""
    s, h = F.trim(F.coalesce(summary, F.lit(""))), F.trim(F.coalesce(headline, F.lit("")))
    return (s != "") & (s != h) & (F.length(s) > F.length(h) + 20)


def reason(explicit: Column, flag: Column) -> Column:
    """The explicit reason, else the flag's text with its mark, else blank."""
    given = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    return F.coalesce(given(explicit), F.concat(F.lit("Flag: "), given(flag)), F.lit(""))


def provenance(parts: dict[str, Column]) -> Column:
    """'A as of 2026-01-02; B as of 2026-02-03.' of the dates that are known; empty without any."""
    known = F.array_compact(F.array(*[F.when(d.isNotNull(), F.concat(F.lit(f"{name} as of "), d)) for name, d in parts.items()]))
    return F.when(F.size(known) == 0, "").otherwise(F.concat(F.array_join(known, "; "), F.lit(".")))


def or_dash(text: Column) -> Column:
    """A blank as a dash."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "—").otherwise(F.trim(text))


def only_link(text: Column) -> Column:
    """The link of a text that is one link and nothing else, else null (F101)."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare.rlike(r"^https?://\S+$"), bare)


def first_url(text: Column) -> Column:
    found = F.regexp_extract(text, r"https?://[^\s<>\"]+", 0)
    return F.when(found != "", found)


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def sparse(**members: Column) -> Column:
    """JSON of a struct without members that are null, zero or empty."""
    kept = [F.when(~c.cast("string").isin("0", "0.0", "", "false"), c).alias(n) for n, c in members.items()]
    return F.to_json(F.struct(*kept))


def links(html: Column) -> Column:
    """Targets of all links of a page in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"']+)"), F.lit(1))


def mail_text(html: Column, cap: int = 3000) -> Column:
    """A mail's text with a line for each block, at most `cap` characters."""
    blocks = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\x01")
    lines = F.transform(F.split(strip_html(blocks), "\x01"), norm)
    return F.substring(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 1, cap)


def decoded_header(header: Column) -> Column:
    """A mail header with its '=?utf-8?B?...?=' words decoded and white space collapsed."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            try:
                return None if value is None else " ".join(str(make_header(decode_header(value))).split())
            except (ValueError, LookupError):
                return " ".join(value.split())

        return values.map(one)

    return F.when(F.contains(header, F.lit("=?")), decode(header)).otherwise(norm(header))


def redact_names(text: Column, names: Column, keep: tuple[str, ...] = (), mark: str = "[redacted]") -> Column:
    """A row's own names struck from its text, in any case, the longest first (P20).

    Names of up to three letters and words that documents of the kind use anyway (`keep`) strike nothing; nor do null lists.
    """
    useful = F.filter(F.array_distinct(names), lambda n: (F.length(n) > 3) & ~F.lower(n).isin(*[k.lower() for k in keep]))
    longest = F.transform(F.array_sort(F.transform(useful, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda s: F.concat(F.lit(r"\Q"), F.replace(s["n"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.coalesce(F.when(F.size(longest) > 0, F.regexp_replace(text, pattern, F.lit(mark))), text)


def evidence(text: Column, start: Column, end: Column, names: Column, cap: int = 320) -> Column:
    """The sentence around a finding, without the row's own names."""
    return redact_names(clause_sentence(text, start, end, cap), names)
