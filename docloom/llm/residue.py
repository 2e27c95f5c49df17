"""Pages that hold template residue, error messages, script demands or filler instead of content.

A page is read as its reader sees it: HTML becomes Markdown lines without scripts and comments, code is left
out, links are their labels, and the block labeller takes the site's furniture off.  What is left is masked
(numbers, addresses, dates) block by block, and the blocks are grouped over all pages by the hash of their
masked text.  How far a text recurs decides what it takes for it to be a message:

* on any page, if every sentence says by a strict phrase rule that this page or request failed, wants scripts,
  or is still to come, or if the block is filler;
* on ``min_sources`` sites, if its sentences only sound like it (a weak phrase, a word of failure);
* on ``min_sources`` sites and pages of as many names (a mirrored page is none), in any wording and length, if
  it makes up, alone or with other such texts, nearly every page it stands on (a notice among real text does not).

A page is a case if its article consists of messages alone (a dump in a code block beside them counts for
nothing), or if an unfilled placeholder, an authoring reminder or a failed value is left anywhere in the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .boilerplate import furniture_lines

MIN_SOURCES = 3
#: of the pages a recurring text stands on, so many must hold recurring texts alone for it to be a message
MIN_WHOLE = 0.8

_UNSEEN = re.compile(r"<!--.*?-->|<(script|style|template|svg|head|select|textarea)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_AROUND = re.compile(r"<(nav|header|footer|aside)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)</noscript\s*>", re.S | re.I)
_PRE = re.compile(r"<pre\b[^>]*>.*?</pre\s*>", re.S | re.I)
_INLINE = re.compile(r"<(code|kbd|samp|q)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_ANCHOR = re.compile(r"<a\b[^>]*?(?:\bhref\s*=\s*[\"']?([^\"'\s>]*)[^>]*)?>(.*?)</a\s*>", re.S | re.I)
_HEADING = re.compile(r"<h([1-6])\b[^>]*>", re.I)
_CELLS = re.compile(r"</t[dh]\s*>\s*<t[dh]\b[^>]*>", re.I)
_ROW = re.compile(r"<tr\b[^>]*>\s*(?:<t[dh]\b[^>]*>)?", re.I)
_ITEM = re.compile(r"<li\b[^>]*>\s*(?:<p\b[^>]*>)?", re.I)
_BLOCK = re.compile(r"</?(?:p|h[1-6]|li|ul|ol|div|main|article|section|table|tr|td|th|dd|dt|dl|figure|figcaption|blockquote|body|html|br|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!][^>]*>")
_IS_HTML = re.compile(r"\s*(?:<!doctype html|<html|<head|<body|<\?xml)", re.I)
_TICKS = re.compile(r"``.*?``|`[^`\n]*`")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s[^()]*)?\)|!?\[([^\[\]]+)\]\[[^\[\]]*\]")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|(?<!\w)\"[^\"]*\"(?!\w)")
_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+")
_DATE = re.compile(r"\b\d{4}-\d\d-\d\d\b|\b\d{1,2}\.? [^\W\d_]{3,}\.? \d{4}\b|\b[^\W\d_]{3,}\.? \d{1,2}, \d{4}\b")
_NUMBER = re.compile(r"\d+")
#: every date has one
_YEAR = re.compile(r"\d{4}")
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789<%@[&_", b"abcdefghijklmnopqrstuvwxyz000000000{{{{{{")

#: placeholders of common template languages, authoring reminders and failed values, sought outside code
PLACEHOLDER = re.compile(
    "|".join(
        [
            r"\{\{[^{}]*\}\}",  # {{ name }}
            r"\{%[^{}]*%\}",  # {% block %}
            r"<%[^<>]*%>",  # <%= name %>
            r"[$#]\{[\w.\s-]+\}",  # ${name} #{name}
            r"%%\w+%%|@@\w+@@|\[\[\s*\w+\s*\]\]",
            r"(?-i:\b__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__\b|(?<![A-Za-z])__[A-Z][A-Z0-9_]*[A-Z]\b)",
            r"(?<![\w{$#%])\{[a-z][a-z_]*\}(?!\})",  # {first_name}
            r"\[(?:insert|enter|add|your|replace)\b[^\]]*\]",
            r"(?:<|&lt;)\s*(?:placeholder|insert[^<>&]*|your[^<>&]*|(?-i:[A-Z]{3,}(?:[ _][A-Z]+)*))\s*(?:>|&gt;)",
            r"(?:^|(?<=[.!?:] ))(?-i:TODO|FIXME|TBD|TBC|XXX)\b\s*(?:[:–—-]|$)",
            r"\(replace this text\.?\)|\breplace this text\b",
            r"(?-i:\[object (?:[A-Z]\w*|null|undefined)\])",
            r"\b(?:hello|hi|dear|welcome|value:|total:|name:|is|of) (?:undefined|null|nan)\b(?! (?:if|when|unless|in|by|means|becomes|as))",
            r"^(?:undefined|null|nan)\.?$",
        ]
    ),
    re.I,
)
_CASED = re.compile(r"(?:<|&lt;)\s*[a-z ]+(?:>|&gt;)")
_MARKS = re.compile(r"[{<%@\[]|&lt;|__|TODO|FIXME|TB[DC]|XXX|[Rr]eplace|REPLACE|[Uu]ndefined|UNDEFINED|[Nn]a[Nn]|NAN|[Nn]ull|NULL")

# Parts of messages.  A strict rule is matched against a whole masked sentence.
_SORRY = r"(?:(?:we(?: are|'re) (?:very |so )?|i(?: am|'m) )?sorry,?(?: but)? |oops!?,? |uh-oh!?,? |whoops!?,? |error:? |unfortunately,? )?"
_PAGE = r"(?:page|site|website|web site|file|resource|document|article|content|url|address|link|topic|version|item|route|path|section|app|application)"
_LOST = r"(?:(?:was|were|is|are|has|have|could|can|does|do|did|may|might|will)(?:n'?o?t|n't|not)? ?(?:not|no longer|been|have|be|longer)* ?(?:been |be )?(?:found|available|exists?|moved|removed|deleted|renamed|located|displayed|loaded|shown|working|responding|reached|unavailable|gone|missing|down|offline|broken)|no longer exists?|(?:not|no longer) (?:found|available)|cannot be (?:found|displayed|reached)|can't be (?:found|displayed|reached))"
_SINCE = r"(?:,? (?:or|and) .*| (?:right now|at the moment|at this time|currently|anymore|any more|here|yet|on this (?:site|server|host)|temporarily|for maintenance|from this server))*"
_CODE = r"(?:(?:http )?(?:error|status|code)(?: code)? ?:? ?)?0?\W*"
_NAMED = r"(?:(?:page|file|resource|document|url|site) (?:could )?not (?:be )?found|not found|bad gateway|internal (?:server )?error|server error|(?:service|site|server|website|page) (?:is )?(?:currently |temporarily )?(?:unavailable|down|overloaded)|service unavailable|temporarily unavailable|forbidden|gateway time-?(?:out|d out)|request time-?(?:out|d out)|access (?:is |was )?denied|permission denied|too many requests|request (?:was )?blocked)"
#: strict rules by kind, for the languages that the tables and most of the web are written in
STRICT = {
    "error": [
        _CODE + _NAMED + r"(?:\W+" + _CODE + _NAMED + r")*|(?:http )?(?:error|status|code)? ?0\W{1,3}(?:gone|error|unauthori[sz]ed|bad request|method not allowed|conflict)",
        _SORRY + r"(?:something|an? (?:unexpected |internal |unknown )?(?:error|problem)) (?:went wrong|(?:has )?(?:occurred|happened))" + _SINCE,
        r"oops!?|whoops!?|sorry!?|we(?: are|'re) sorry",
        _SORRY + rf"(?:the|this|that) (?:requested |missing )?{_PAGE}(?: (?:that )?you (?:(?:a|we)re |have |had )?(?:asked|looking|look|requested|trying|tried|followed|clicked|wanted|want|were)\b.*?)? {_LOST}{_SINCE}",
        rf"the (?:requested )?{_PAGE} you (?:asked|were looking|are looking|requested|tried|followed)\b.*",
        r".*\bdoes not exist or has moved",
        r".*\b(?:could not|couldn't|cannot|can't|was unable to|were unable to|are unable to|unable to) (?:complete|process|handle|find|serve|fulfil+|load|display) (?:your request|what you (?:were|are) looking for|(?:the|this|that) page)\b.*",
        r".*\byou (?:do not|don't) have (?:the )?(?:permission|access|rights)\b.*|you are not (?:allowed|authori[sz]ed|permitted) to .*",
        r"(?:your )?(?:rate limit|quota|request limit) (?:reached|exceeded|has been .*).*|you have (?:sent|made) too many requests.*",
        r"the upstream server .*|this link is (?:broken|dead).*|traceback \(most recent call last\).*",
        r"(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?(?:human|not a robot).*|checking your browser.*|are you a (?:robot|human).*|(?:your )?(?:request|ip|access|address)\b.{0,20} (?:has been|was|is) blocked.*",
        r"(?:the )?(?:site|service|server|page|website|we) (?:is|are) (?:currently |temporarily )?(?:down|offline|closed|unavailable)(?: for (?:\w+ )?maintenance)?.*",
        r"(?:angeforderte |gesuchte |die |diese |die angeforderte |die gesuchte )?seite (?:wurde |konnte |ist |existiert )?(?:leider )?(?:nicht (?:mehr )?(?:gefunden|verfügbar|vorhanden|erreichbar)(?: werden)?|nicht(?: mehr)?)|die angeforderte seite .*|(?:etwas ist|leider ist etwas) schiefgelaufen|zugriff verweigert|ein fehler ist aufgetreten.*",
        r"(?:cette |la )?page (?:demandée |recherchée )?(?:est )?(?:introuvable|n'existe (?:pas|plus)|n'est (?:pas|plus) disponible)|la page (?:demandée|que vous (?:cherchez|recherchez)) .*|accès refusé|une erreur (?:s'est produite|est survenue).*",
        r"(?:la |esta )?página (?:solicitada )?(?:no (?:se ha |fue |ha sido )?(?:encontrad[ao]|existe|está disponible)|ya no existe)|no encontramos lo que .*|la página (?:solicitada|que busca) .*|acceso denegado|algo salió mal|(?:se ha producido|ha ocurrido|ocurrió) un error.*",
        r"(?:la )?pagina (?:richiesta )?(?:non (?:è stata )?(?:trovata|esiste|disponibile))(?: più)?|accesso negato|(?:a |esta )?página (?:solicitada )?não (?:foi )?(?:encontrada|existe)|pagina niet gevonden|strona nie (?:została )?znaleziona|страница не найдена|доступ запрещ[её]н",
        r"(?:お探しの)?ページ(?:が|は)(?:見つかり|存在し|ご?利用でき).*|お探しのページ.*|页面(?:不存在|未找到|无法.*)|找不到(?:该|此)?页面|您(?:访问|请求|查找)的页面.*|페이지를 찾을 수 없습니다",
    ],
    "scripts": [
        r"(?:please |you (?:need|have) to |you must |to (?:continue|view this page|use this (?:site|app)),? (?:please )?)?(?:enable|activate|turn on|allow|switch on) (?:your )?(?:javascript|scripts|scripting)\b.*",
        r"(?:please )?(?:turn|switch) (?:javascript|scripts|scripting) (?:back )?on\b.*",
        r"(?:javascript|scripts?|scripting) (?:is|are|must be|has to be|needs to be|have to be) (?:required|disabled|needed|enabled|off|turned off|turned on|switched off|not enabled|not available)\b.*",
        r"(?:sorry, )?(?:this|the|our) (?:site|website|page|app|application|documentation) (?:needs|requires|relies on|does(?:n't| not) work without|only works with|cannot (?:be shown|work) without|won't work without) (?:javascript|scripts?|scripting)\b.*",
        r"your browser (?:does(?:n't| not) support|has disabled|is blocking|blocks) (?:javascript|scripts?).*|(?:you need|we need|needs?) (?:javascript|scripts)\b.*|loading.{0,3} if nothing happens.*|.*\benable (?:javascript|scripts) and reload",
        r"(?:veuillez |merci d')?activer javascript.*|(?:bitte )?aktivieren sie javascript.*|javascript (?:ist|wird) .{0,20}(?:deaktiviert|benötigt|erforderlich).*|activ[ea] javascript.*|habilite javascript.*|javascript est (?:requis|désactivé|nécessaire).*|(?:ative|abilita|attiva) (?:o )?javascript.*|включите javascript.*",
        r"このページを表示するにはスクリプトを有効に.*|.*javascriptを有効に.*|请(?:启用|开启|打开) ?(?:javascript|脚本).*|javascript를 (?:활성화|사용).*",
    ],
    "announced": [
        r"(?:more )?(?:(?:content|documentation|docs|details|examples) )?(?:is |are )?(?:coming|available) (?:very )?soon|stay tuned|watch this space",
        r"(?:this |the |our )?(?:page|section|site|website|chapter|guide|article|documentation)? ?(?:is |are )?(?:still |currently )?(?:under construction|being (?:written|built|prepared)|work in progress|in progress|in preparation|a stub|not (?:yet )?(?:ready|written|finished|available)(?: yet)?)",
        r"(?:nothing|no content|there is nothing|there is no content) (?:to see )?here yet.*|(?:this |the )?(?:content|text|page|section|documentation) (?:will (?:be (?:added|written|published|available)|follow|come|appear)|to come|is to come|is coming|coming|follows) ?(?:here|soon|later|shortly|in .*|at .*|with .*)?|.*\bcheck back (?:later|soon|in .*)",
        r"diese seite befindet sich (?:noch )?im aufbau|im aufbau|(?:diese )?(?:seite|inhalte?) (?:folgt|folgen|wird|werden) .*|in (?:kürze|arbeit)(?: verfügbar)?|(?:cette |la )?(?:page|site) (?:est )?en (?:cours de )?construction|(?:esta |la )?(?:página|sitio) (?:está )?en construcción|próximamente|bientôt disponible|em construção|em breve|in costruzione|prossimamente|скоро",
        r"(?:このページは)?(?:現在)?(?:準備中|工事中|作成中)(?:です)?|近日公開.*|敬请期待|(?:本页|页面|网站)?(?:正在)?建设中|即将推出|준비 ?중(?:입니다)?",
    ],
}
#: what stands beside a message, and what sounds like one: a text of nothing but these must recur
_BESIDE = r"(?:error |code |status )?0|back to (?:home|start|the (?:home|start) ?page)|(?:reference|request|ray|incident|trace|event) (?:id|code|number)\b.*|[a-z-]+/0(?:\.0)*|(?:please )?(?:try|retry) (?:again|later|the request).*|go (?:back|home)|home|return to .*|(?:please )?contact (?:us|the |your |our |support|administrator).*|(?:please )?(?:check|use|try) (?:the |your )?(?:address|url|spelling|search|menu|link).*|thank you for your patience"
_SOUNDS = re.compile(
    r"\b(?:not (?:be )?found|unavailable|not available|does(?:n't| not) exist|no longer exists?|went wrong|denied|forbidden|time-?out|timed out|isn't working|not working|maintenance|blocked|captcha|robots?|javascript|scripts?|cookies|coming soon|under construction|try again|reload|refresh|moved|nicht gefunden|introuvable|no existe|non trovata|não encontrada)\b"
    r"|見つかり|有効に|準備中|不存在|找不到|启用"
)
_KINDS = {k: re.compile("|".join(f"(?:{p})" for p in rules), re.S) for k, rules in STRICT.items()}
_WEAK = re.compile(_BESIDE, re.S)
#: kinds of what is a message only if it recurs
LOOSE = ("", "weak", "sounds")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])(?!$)")
_EDGE = " .!?…:;,-–—。！？\"'“”()*_"
#: words of placeholder Latin: the traditional passage's and the commonly generated ones
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur "
    "sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum altum corvus facilis ferro lacus memora nihil nullam ornare "
    "pellis porta quantum rutrum sagitta semper tempora tincto ultra velaris vesper vivere "
    "vestibulum pellentesque curabitur vivamus phasellus maecenas praesent aenean integer mauris morbi donec fusce nunc eget vel ac ante arcu augue bibendum blandit "
    "condimentum congue cras cursus dapibus diam dictum dignissim dui egestas eleifend elementum erat eros etiam euismod facilisis faucibus felis fermentum feugiat "
    "gravida hendrerit iaculis imperdiet justo lacinia lectus libero ligula lobortis luctus malesuada massa mattis metus nec neque nibh nisl odio orci pharetra".split()
)
_LATIN_END = re.compile(r"(?:us|um|is|it|at|ur|unt|ibus|orum|arum|que|ae|am|em|it|et)$")
_WORDS = re.compile(r"[^\W\d_]+")


def _folded(text: str) -> str:
    """ASCII in small letters, digits as 0, the marks of placeholders as a brace; other characters are of no use in it."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("latin-1")


def _may_hold(block: str) -> bool:
    """False for most blocks without a match of ``_MARKS``, which is a slower test."""
    x = _folded(block)
    return "{" in x or "null" in x or "nan" in x or "replace" in x or "undefined" in x or "todo" in x or "fixme" in x or "tb" in x or "xxx" in x


def mask(block: str) -> str:
    s = " ".join(block.split())
    if "://" in s or "www." in s:
        s = _ADDRESS.sub("address", s)
    seen, plain = _folded(s), s.isascii()
    if "0" in seen or not plain:  # other scripts have digits of their own
        dated = "0000" in seen if plain else _YEAR.search(s)
        s = _NUMBER.sub("0", _DATE.sub("0", s) if dated else s)
    return s.strip(" *_>#—–-").lower()


def is_filler(block: str) -> bool:
    """Placeholder Latin, or one or two words over and over."""
    said = _WORDS.findall(block.lower())
    kinds = set(said)
    if len(kinds) == 1 and len(said) >= 3 or len(kinds) == 2 and len(said) >= 6:
        return True
    known = sum(w in LATIN for w in said)
    if len(said) < 4:
        return len(said) > 1 and known == len(said) and not kinds.isdisjoint(("lorem", "ipsum"))
    if known >= 0.7 * len(said):
        return True
    long = [w for w in said if len(w) > 3]
    return len(said) >= 6 and known > 0 and bool(long) and sum(w in LATIN or bool(_LATIN_END.search(w)) for w in long) >= 0.8 * len(long)


def has_placeholder(block: str) -> bool:
    """Whether a reader of ``block``, code taken out, sees an unfilled placeholder, a reminder or a failed value."""
    if not _may_hold(block) or not _MARKS.search(block):
        return False
    found = PLACEHOLDER.search(_QUOTED.sub("", block))
    return found is not None and not _CASED.fullmatch(found[0])


def _strict(sentence: str) -> str:
    return next((k for k, rule in _KINDS.items() if rule.fullmatch(sentence)), "")


def message(masked: str) -> str:
    """A strict message's kind, 'filler', 'weak' or 'sounds' for what must recur to be one, '' for ordinary text."""
    return _short_message(masked) if len(masked) <= 200 else _message(masked)  # long texts are not kept in memory


def _message(masked: str) -> str:
    if is_filler(masked):
        return "filler"
    parts = [p for p in (s.strip(_EDGE) for s in _SENTENCE.split(masked)) if p]
    kinds = [_strict(p) or ("weak" if _WEAK.fullmatch(p) else "sounds" if _SOUNDS.search(p) else "") for p in parts]
    if not kinds or "sounds" in kinds or "" in kinds:
        whole = _strict(masked.strip(_EDGE)) if len(parts) > 1 else ""  # some rules span sentences
        return whole or ("" if not kinds or "" in kinds else "sounds")
    return next((k for k in kinds if k != "weak"), "weak")


_short_message = lru_cache(maxsize=50_000)(_message)


def classify(block: str) -> str:
    """What a block is on any page: 'placeholder', a strict message's kind, 'filler', 'weak', or '' for ordinary text."""
    return "placeholder" if has_placeholder(block) else message(mask(block)).replace("sounds", "")


def _read(block: str) -> tuple[bool, str, int | None]:
    """Whether ``block`` has a placeholder, its mask, and the hash of this, null if it is not compared."""
    m = mask(block)
    bare = "`c`" in block or not _WORDS.search(m) and "0" not in m  # a rule or a mark says nothing
    return has_placeholder(block), m, None if bare else xxhash.xxh64_intdigest(m) - 2**63


_short_read = lru_cache(maxsize=50_000)(_read)


def read_block(block: str) -> tuple[bool, str, int | None]:
    return _short_read(block) if len(block) <= 200 else _read(block)


def markdown_of(text: str) -> str:
    """The page's visible text as Markdown lines; a script notice counts where nothing else is shown."""
    notices = [_TAG.sub("", x) for x in _NOSCRIPT.findall(text)]
    body = _UNSEEN.sub("", _NOSCRIPT.sub("", text))
    if not html.unescape(_TAG.sub("", body)).strip():
        return "\n\n".join(html.unescape(n).strip() for n in notices)
    body = _AROUND.sub("\n", _PRE.sub("\n```\x00```\n", body))
    body = " ".join(_INLINE.sub("`c`", body).split())
    body = _ANCHOR.sub(lambda m: f"[{_TAG.sub('', m[2])}]({m[1] or ''})" if m[2].strip() else "", body)
    body = _ITEM.sub("\n- ", _ROW.sub("\n\x02", _CELLS.sub(" \x01 ", body)))
    body = _HEADING.sub(lambda m: "\n" + "#" * int(m[1]) + " ", body)
    out = []
    for part in _BLOCK.sub("\n", body).replace("```\x00```", "\n```\x00```\n").split("\n"):
        bare = " ".join(html.unescape(_TAG.sub("", part) if "<" in part else part).split())
        if bare == "```\x00```":
            out.append("```\n```")
        elif bare.startswith("\x02"):
            out.append("| " + bare[1:].replace("\x01", "|").strip() + " |")
        elif bare.strip("-# "):
            out.append(bare.replace("\x01", "|"))
    return "\n\n".join(out)


_FENCES = ("`", "~")


def markdown_lines(text: str) -> list[tuple[int, bool, str]]:
    """(line number, is heading, text with code as `c` and links as their labels) of the non-blank lines; a fence is one line of code."""
    out, fence = [], ""
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if bare[:1] in _FENCES and bare.startswith(("```", "~~~")) and (not fence or bare.startswith(fence)):
            if not fence:
                out.append((n, False, "`c`"))
            fence = "" if fence else bare[:3]
        elif bare and not fence:
            head = bare[0] == "#" and bare.lstrip("#")[:1] == " "
            seen = _TICKS.sub("`c`", bare.lstrip("#") if head else bare) if "`" in bare else bare.lstrip("#") if head else bare
            if "](" in seen or "][" in seen:
                seen = _LINK.sub(lambda m: m[1] or m[2] or "", seen)
            seen = seen.strip()
            if seen:
                out.append((n, head, seen))
    return out


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources, names, texts, types = (batch.column(i).to_pylist() for i in range(5))
        kept = [i for i, t in enumerate(texts) if t]
        read = []
        for i in kept:
            said = (types[i] or "").lower()
            read.append(markdown_of(texts[i]) if ("html" in said if said else _IS_HTML.match(texts[i])) else texts[i])
        rows: dict[str, list] = {k: [] for k in _SCHEMA.names}
        # every page's furniture is taken off, as any text may turn out to recur
        for i, text, gone in zip(kept, read, furniture_lines(read)):
            drop, found = set(gone), markdown_lines(text)
            lines = [x for x in found if x[0] not in drop]
            n_own = sum("`c`" in b and b != "`c`" and not head for _, head, b in lines)  # what its code says is not compared
            # a message that stands in the article's place is none of the furniture
            if drop and not n_own:
                lines = [x for x in found if x[0] not in drop or message(read_block(x[2])[1]) not in LOOSE]
            marked, said = False, {}
            for _, head, b in lines:
                holds, m, h = read_block(b)
                if holds:
                    marked = True
                    continue
                if h is None:
                    continue
                k = "" if n_own else message(m)  # no page of its own text is one of messages alone
                if not k and head:
                    continue
                said[h] = min(k, said.get(h, k))
            rows["row_id"].append(ids[i])
            rows["text_hash"].append(xxhash.xxh64_intdigest(texts[i]) - 2**63)
            rows["source"].append(sources[i])
            rows["name"].append(names[i])
            rows["placeholder"].append(marked)
            rows["n_own"].append(n_own)
            rows["blocks"].append([{"hash": h, "kind": k} for h, k in said.items()])
        yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [
        ("row_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("source", pa.string()),
        ("name", pa.string()),
        ("placeholder", pa.bool_()),
        ("n_own", pa.int64()),
        ("blocks", pa.list_(pa.struct([("hash", pa.int64()), ("kind", pa.string())]))),
    ]
)


def residue_pages(tables: list[tuple], min_sources: int = MIN_SOURCES) -> DataFrame:
    """Distinct ``(src_table, row_id)`` of the pages that are residue.

    ``tables`` lists ``(src_table, df, row_id, url, text)`` and, where there is one, the column of the content
    type: a type that names HTML is read as that and any other as plain text; where it is null or not given, the
    text's beginning tells.  Blocks are grouped over all tables, by the host of ``url`` (a null url is a site of its
    own) and the last part of its path.  Null and empty texts are no cases, and rows repeated give one result; an
    id with several texts is a case if one of them is.
    """
    parts = []
    for name, df, row_id, url, text, *kind in tables:
        path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
        rows = df.select(
            F.col(row_id).cast("long").alias("row_id"),
            F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit("")).alias("source"),
            F.substring_index(F.rtrim(path, F.lit("/")), "/", -1).alias("name"),
            F.col(text).alias("text"),
            (F.col(kind[0]) if kind else F.lit(None)).cast("string").alias("type"),
        )
        ddl = "row_id long, text_hash long, source string, name string, placeholder boolean, n_own long, blocks array<struct<hash:long,kind:string>>"
        parts.append(rows.mapInArrow(_pages, ddl).withColumn("src_table", F.lit(name)))
    pages = parts[0]
    for p in parts[1:]:
        pages = pages.union(p)
    pages = written(pages)
    page = ["src_table", "row_id", "text_hash"]
    blocks = pages.select(*page, "source", "name", "placeholder", "n_own", F.explode("blocks").alias("b")).select(*page, "source", "name", "placeholder", "n_own", "b.hash", "b.kind")
    loose = blocks.where(F.col("kind").isin(*LOOSE))
    over = lambda of: loose.select("hash", of).distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sources).select("hash")
    on_sites = over("source").withColumn("sites", F.lit(True))
    on_names = over("name").withColumn("names", F.lit(True))
    wide = written(on_sites.join(on_names, "hash", "left"))
    known = (
        F.when(F.col("kind").isin("weak", "sounds"), F.col("sites").isNotNull())
        .when(F.col("kind") == "", F.col("sites").isNotNull() & F.col("names").isNotNull())
        .otherwise(True)
    )
    unsure = F.col("kind").isin("", "sounds")
    # pages of which every block is a message or recurs; only their texts can be messages
    marked = blocks.where("n_own = 0 and not placeholder").join(wide, "hash", "left")
    whole = written(marked.groupBy(*page).agg(F.every(known).alias("whole"), F.collect_set(F.when(unsure, F.col("hash"))).alias("texts")).where("whole"))
    texts = whole.select(F.explode("texts").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_whole"))
    stands = blocks.where(unsure).join(texts, "hash").groupBy("hash", "n_whole").agg(F.count_distinct(*page).alias("n_pages"))
    told = stands.where(F.col("n_whole") >= MIN_WHOLE * F.col("n_pages")).select("hash", F.lit(True).alias("told"))
    messages = whole.select(*page, F.explode_outer("texts").alias("hash")).join(told, "hash", "left").groupBy(*page).agg(F.every(F.col("hash").isNull() | F.col("told").isNotNull()).alias("all")).where("all")
    return pages.where("placeholder").select("src_table", "row_id").union(messages.select("src_table", "row_id")).distinct()


def without_residue(df: DataFrame, cases: DataFrame, *, src_table: str, row_id: str) -> DataFrame:
    """``df`` without the rows whose id is among the cases of ``src_table``; rows with a null id stay."""
    gone = cases.where(F.col("src_table") == src_table).select(F.col("row_id").alias("__gone"))
    return df.join(gone, F.col(row_id) == F.col("__gone"), "left_anti")
