"""Labels for the block labeller's training lines: which lines are site furniture.

Labels come from patterns of well-known furniture (menus, consent notices, outlines, bylines, footers)
and from the block around a line (what follows an outline's title, runs of menu entries).  They are used
for training and for held-out accuracy only; the operator itself reads the trained network.
"""

from __future__ import annotations

import re

import regex

MENU = set(
    "academy api benchmarks blog brand changelog cloud community contribute download events examples faq forum glossary "
    "guide integrations migration partners plugins pricing recipes reference roadmap security showcase status support team tutorial".split()
)
OUTLINE_TITLES = {"on this page", "contents", "jump to", "sections", "page outline", "table of contents"}
RELATED_TITLES = {"you may also like", "more from the blog", "popular this week", "related articles"}
KIND = r"(?:lesson|chapter|guide|handbook|manual|entry|article)"
DATE = r"(?:\d{4}-\d\d-\d\d|\d{1,2}\.? [a-z]+\.? \d{4}|[a-z]+\.? \d{1,2}, \d{4})"
NAME = r"(?:[^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*){0,3})"
PATTERNS = [
    r"english · deutsch · français · 日本語",
    r"follow us: .*",
    r"copyright \d{4}, the \S+ authors\. created using \S+",
    r"all rights reserved",
    r"back to top ↑?",
    r"made with care by the \S+ community",
    r"built with \S+ [\d.]+",
    r"site map|rss|got it|☰|menu|search|show source|edit this page|view page source|suggest an edit|✏️ improve this page",
    r"theme: light dark auto",
    r"privacy \| terms \| imprint \| status",
    r"© \d{4} \S+ contributors(?:, released under the .* terms)?",
    r"contact · press kit · careers",
    rf"this {KIND} is for \S+ [\d.]+ and may be out of date",
    r"written by .* · \d+ min read",
    rf"\d+ readers passed this {KIND} on\. share yours!",
    r"stable \([\d.]+\)(?: · [\d.]+)+",
    rf"copy link to this {KIND}: \S+",
    rf"you are reading the \S+ [\d.]+ {KIND}; the newest release is [\d.]+",
    r"v[\d.]+ \(latest\)(?: v[\d.]+)+",
    rf"tweetle this · pin this · mail this {KIND}",
    rf"names and marks on this {KIND} page belong to the \S+ foundation",
    rf"rate this {KIND}: ★.* \(\d+ votes\)",
    r"version: [\d.]+ ▾(?: [\d.]+)+",
    r"skip to content|jump to main|zum inhalt springen|\[skip to main content\]\(#main\)",
    r"you@mailbox\.example \[sign up\]",
    r"search ⌘k|press / to search|\[ \] search the docs|search docs…",
    r"report an issue with this page",
    rf"{KIND} feed \| print this {KIND} \| ask the \S+ forum",
    rf"\S+ is provided as is, without any promise of fitness for your {KIND}",
    rf"reviewed {DATE} for \S+ [\d.]+",
    r"🍪 a quick word about cookies",
    r"we and our partners keep data on your device to improve the docs",
    r"accept all cookies|consent choices|manage preferences|reject non-essential|learn more in our privacy notice",
    r"this website stores small files on your device\. accept all · only necessary · settings",
    rf"spotted a mistake\? tell the \S+ {KIND} maintainers",
    r"sign up for \S+ office hours, every week at \S+",
    r"by browsing on you agree to our cookie policy",
    r"your privacy matters to us: choose which trackers you allow",
    r"we use cookies to make this site work and to measure how it is read",
    r"allow analytics\? yes / no / ask me later",
    rf"liked it\? send this \S+ {KIND} to a colleague",
    rf"last updated on {DATE} by .*",
    rf"posted {DATE} in {KIND}",
    rf"was this {KIND} helpful\? yes \(\d+\) no \(\d+\)",
    rf"{NAME}, \S+ docs, {DATE}",
    rf"content on the \S+ {KIND} site may not be resold",
    rf"share this {KIND}: mastpole \| plumeo \| copy link",
    rf"code samples in this {KIND} are dedicated to the public under .*",
    r"sponsored: try hosted \S+ free for \d+ days",
    r"new course: \S+ from scratch, seats limited",
    r"take the \S+ user survey \(\d+ questions\)",
    r"subscribe to our newsletter",
    r"star us on the code forge ★ \d+k",
    r"hiring: come work on \S+",
    r"need help\? chat with the \S+ crew",
    r"join \d+ builders who get our monthly digest",
    r"continuer sans accepter|tout accepter|ce site utilise des témoins de connexion pour mesurer l'audience",
    r"alle akzeptieren|nur notwendige|einstellungen zum datenschutz|wir verwenden cookies, um diese seite zu verbessern",
    r"このサイトはクッキーを使用しています。?|すべて許可|設定を変更",
    r"本站使用 cookie 改善体验。?|全部接受|仅限必要",
    r"usamos cookies para que el sitio funcione|aceptar todas|configurar|rechazar",
    r"‹ .*  .* ›|previous .* \| next .*|← .*|.* →|prev(?:ious)?: .*|next: .*",
    r"docs(?: [>›»/] .+)+",
    rf"in this {KIND}",
]
FIXED = re.compile("|".join(PATTERNS))
#: patterns that say something before their end: what a cut-off last line is held against
PARTIAL = regex.compile("|".join(x for x in PATTERNS if not x.startswith(("‹", r"(?:[^\W", r"\S"))))
_EDGE = re.compile(r"^[\s*_>—–-]+|[\s*_.]+$")
_MENU_ITEM = re.compile(r"^\s*(?:[-*+•]\s+)?(?:\[([^\]]+)\]\([^)]*\)|([^\[\]]+))\s*$")
_SIDE_ITEM = re.compile(r"^\s*[-*+•]?\s*\[[^\]]+\]\((?:\.\./|/)[^)]*\)\s*$")
_ANCHOR = re.compile(r"^\s*(?:[-*+•]\s+)?\[[^\]]*\]\(#[^)]*\)\s*$")


def plain(line: str) -> str:
    return re.sub(r"\s+", " ", _EDGE.sub("", line.lower().replace("\r", ""))).strip()


def _menu(line: str) -> bool:
    m = _MENU_ITEM.match(line)
    if not m:
        return False
    words = [w for w in re.split(r"\s*[·|/]\s*|\s{2,}", (m[1] or m[2]).strip().lower()) if w]
    return bool(words) and all(w in MENU for w in words)


def labels(text: str) -> list[int | None]:
    """1 furniture, 0 not, None for blank lines."""
    lines = text.replace("\r", "").split("\n")
    out: list[int | None] = [None if not x.strip() else 0 for x in lines]
    heads = {plain(re.sub(r"^#+\s*", "", x)) for x in lines if re.match(r"#{1,6} ", x)}
    fence = False
    mode = ""
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fence, mode = not fence, ""
            continue
        if fence or out[i] is None:
            continue
        p = plain(line)
        if re.match(r"#{1,6} ", line):
            mode = ""
        elif FIXED.fullmatch(p) or FIXED.fullmatch(line.strip().lower()) or (FIXED.fullmatch(re.sub(r"\s+", " ", line.strip().lower())) is not None):
            out[i], mode = 1, "outline" if re.fullmatch(rf"in this {KIND}", p) else "related" if p in RELATED_TITLES else ""
        elif p in OUTLINE_TITLES:
            out[i], mode = 1, "outline"
        elif p in RELATED_TITLES:
            out[i], mode = 1, "related"
        elif _menu(line):
            out[i], mode = 1, "side"
        elif _ANCHOR.match(line) or _SIDE_ITEM.match(line):
            out[i] = 1
        elif mode == "outline" and (plain(re.sub(r"^\s*[-*+•]\s+", "", line)) in heads or re.match(r"^\s*•\s", line)):
            out[i] = 1
        elif i == len(lines) - 1 and len(p) >= 8 and PARTIAL.fullmatch(p, partial=True):
            out[i] = 1  # a text cut off within its last line
        else:
            mode = ""
    return out
