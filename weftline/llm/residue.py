"""Template residue, filler, error pages and demands for scripts instead of content (problem 9).

Texts are cut into messages (sentences and lines). Message templates are mined with a fixed-depth prefix tree: numbers
and identifiers are masked, messages are placed in a leaf by their number of words and their first words, and join the most
similar template of the leaf, whose differing words become wildcards. Each task mines its own rows; the templates of all
tasks are then mined again, leaf by leaf, a leaf of very many templates by further words. Every template is classified once,
as error message, demand for scripts, filler or content: by seed phrases, or, where none is in it, by its support, that is by
the number of texts that are nothing but this message, and by the words of servers and browsers in it. The verdicts go back to
the messages by their leaf: to all tasks if there are at most SHIPPED condemned templates, else by a join. A text of which such
messages take the place of the content is a case. Unresolved slots inside ordinary texts are found separately, by their syntax and the words inside them, outside
quotations and code.

Cases: NULL and blank texts are no cases; `doc_id` is returned once however often it occurs; empty tables give empty results;
all other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, spread

#: Words of the prefix a leaf is found by, least share of equal words for a template, templates a task keeps before handing them on.
DEPTH, SIMILAR, KEPT = 2, 0.6, 20_000
#: Templates of a leaf that one task merges, condemned templates that are sent to all tasks, messages remembered by a task, texts
#: that must be nothing but a message for its support to count, and the share of server words it then needs.
CROWD, SHIPPED, MEMO, SUPPORT, SYSTEM_SHARE = 2000, 50_000, 200_000, 3, 0.3
WILD = "<*>"
CJK = "㐀-䶿一-鿿"

# --- Slots ------------------------------------------------------------------------------------------------------------

# Words inside a bracket that ask for something to be filled in.
_ASK = r"(?:insert|your|fill|enter|type|add|write|tbd|tbc|todo|placeholder|(?:object|image|photo|scene|place|user|product|company|first|last|full|file|street|city)[ _](?:name|title|description)|name|title|description|caption|label|text here|goes here|escrib[ae]|insert[ae]r?|rellen[ae]|nombre|título|descripción|texto aquí|aquí|ins[ée]r(?:er|ez)|saisi[rs]|rempli[rs]|nom de|titre|votre|ici|einf[üu]gen|eintragen|eingeben|hier|beschreibung|bezeichnung|ihr(?:e|en)?|填写|输入|插入|此处|在此|待补充|待填|名称|描述)"
_SLOT = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|\$\{[^{}\n]{1,40}\}|\$[A-Z]+_[A-Z_]+\b|%\(\w{1,30}\)[sdfr]|(?<![A-Za-z0-9%])%[sd](?![A-Za-z0-9])|\[\[[\w .|-]{1,40}\]\]"
    r"|<<[\w .-]{1,40}>>|@@[\w .-]{1,40}@@|##[A-Za-z_]{2,40}##|(?<![A-Za-z0-9_])__[A-Za-z][A-Za-z ]{1,38}__(?![A-Za-z0-9_])|(?<![A-Za-z0-9_{$])\{(?:[A-Za-z_][\w.]{0,30}|\d{1,2})\}(?!\})|(?<![A-Za-z0-9])X{4,}(?![A-Za-z0-9])"
    rf"|\[(?=[^\]\n]{{2,60}}\])(?i:[^\]\n]*\b{_ASK}\b[^\]\n]*|[^\]\n]*(?:填写|输入|插入|此处|待补充)[^\]\n]*)\]|\[[A-Z]{{2,}}(?:[ _][A-Z]{{2,}})+\]"
    rf"|<(?=[^>\n]{{4,60}}>)(?:(?i:[^>\n/=\"]*\b{_ASK}\b[^>\n/=\"]* [^>\n/=\"]*)|(?i:[^>\n/=\"]* [^>\n/=\"]*\b{_ASK}\b[^>\n/=\"]*)|[A-ZÀ-Þ]{{2,}}(?:[ _'’](?:[A-ZÀ-Þ]+))+)>"
    rf"|&lt;(?:[\w .-]{{1,40}})&gt;|【[^】\n]*(?:填写|输入|插入|此处|描述|待)[^】\n]*】|[(（](?=[^()（）\n]{{4,50}}[)）])(?i:(?:insert|enter|your|add) [^()\n]*here|[^()\n]*\b(?:hier einf[üu]gen|hier eintragen|ins[ée]rer ici|à compléter|inserte? aquí|escriba aquí|texto aquí)[^()\n]*|[^（）\n]*(?:此处填写|在此填写|在此输入|此处插入)[^（）\n]*)[)）]"
)
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)
_QUOTED = re.compile(r"(?<!\w)['‘]([^'‘’\n]{1,200}?)['’](?!\w)|[\"“„«]([^\"“”»\n]{1,200}?)[\"“”»]|「([^」\n]{1,200}?)」")
_TALKS = re.compile(r"(?i)template|placeholder|syntax|slot|variable|builder|format string|plantilla|marcador|modèle de|gabarit|vorlage|platzhalter|variable|模板|占位符|变量")


def has_slot(text: str) -> bool:
    """An unfilled placeholder where content belongs: not in code, nor quoted by a text that talks about templates."""
    if not re.search(r"[{}\[<%$@_X&【(（#]", text):
        return False
    text = _CODE.sub(" ", text)
    for m in _SLOT.finditer(text):
        quoted = any(q.start() < m.start() and m.end() < q.end() for q in _QUOTED.finditer(text, max(0, m.start() - 210), min(len(text), m.end() + 210)))
        near = text[max(0, m.start() - 160) : m.end() + 160]
        if not (quoted and len(m[0]) < 200 and _TALKS.search(near)):
            return True
    return False


# --- Messages and templates -------------------------------------------------------------------------------------------

_BREAK = re.compile(r"[\r\n]+|(?<=[.!?])\s+|(?<=[。！？])")
_WORD = re.compile(f"[{CJK}]+|[^\\W_{CJK}]+(?:['’][^\\W_{CJK}]+)*|[{{}}<>\\[\\]\"]")
_WRAPPED = re.compile(r"<(\w+)>([^<>]{3,})</\1>|\{\s*\"error\".*\"(?:message|detail|reason)\"\s*:\s*\"([^\"]{3,})\".*\}")
_LONG = 120


def pieces(message: str) -> list[str]:
    """A message of more than _LONG words in consecutive pieces of about the same number of words, at most _LONG; all of its text."""
    at = [m.start() for m in _WORD.finditer(message)]
    n = -(-len(at) // _LONG)
    if n < 2:
        return [message]
    cuts = [0, *(at[len(at) * i // n] for i in range(1, n)), len(message)]
    return [message[a:b].strip() for a, b in zip(cuts, cuts[1:])]


def messages(text: str) -> list[str]:
    """Sentences and lines of a text, overlong ones in pieces; a line that only wraps a message in a tag or a JSON error gives the message."""
    out = []
    for line in re.split(r"[\r\n]+", text):
        line = line.strip()
        if not line:
            continue
        if (m := _WRAPPED.fullmatch(line)) and len(line) < 400:
            out.append(m[2] or m[3])
        else:
            out += [s.strip() for s in _BREAK.split(line) if s.strip()]
    return [p for m in out for p in (pieces(m) if len(m) > _LONG else [m])]


def masked(message: str) -> tuple[str, ...]:
    """Words of a message, numbers and identifiers being wildcards (names become so as templates meet)."""
    words = _WORD.findall(message)
    return tuple(WILD if any(c.isdigit() for c in w) else w.lower() for w in words)


def leaf_of(words: tuple[str, ...]) -> str:
    """Path to the leaf: number of words, then the first words that are no wildcards' neighbours."""
    return f"{len(words)} " + " ".join(words[:DEPTH])


def similarity(template: tuple[str, ...], words: tuple[str, ...]) -> float:
    return sum(t == w != WILD or t == WILD == w for t, w in zip(template, words)) / max(1, len(words))


class Tree:
    """Templates by leaf, each with its messages, the texts that are nothing but it, and its founding message. A message changes
    or founds one template of its leaf."""

    def __init__(self) -> None:
        self.leaves: dict[str, list[list]] = {}
        self.known: dict[tuple[str, ...], list] = {}
        self.size = 0

    def add(self, words: tuple[str, ...], count: int = 1, whole: int = 0, example: str | None = None, leaf: str | None = None) -> None:
        held = self.known.get(words)
        if held is None:
            templates = self.leaves.setdefault(leaf or leaf_of(words), [])
            best = 0.0
            for t in templates:
                x = similarity(t[0], words)
                if x > best:
                    best, held = x, t
            if held is None or best < SIMILAR:
                held = [words, 0, 0, example or " ".join(words)]
                templates.append(held)
                self.size += 1
            elif held[0] != words:
                # The path itself stays, so that the leaf of a template is that of its messages.
                held[0] = tuple(a if a == b or k < DEPTH else WILD for k, (a, b) in enumerate(zip(held[0], words)))
            if len(self.known) < MEMO:
                self.known[words] = held
        held[1] += count
        held[2] += whole

    def drain(self) -> list[tuple[str, int, int, str]]:
        t = [(" ".join(w), n, whole, first) for leaf in self.leaves.values() for w, n, whole, first in leaf]
        self.leaves, self.known, self.size = {}, {}, 0
        return t


# --- Verdicts on templates --------------------------------------------------------------------------------------------

# Phrases of messages a server sends instead of a page (templates are in lower case).
ERROR_PHRASES = re.compile(
    r"(?:page|resource|image|file|url|album|gallery)\b.{0,40}\b(?:not found|could not be found|cannot be found|can't be found|does not exist|no longer (?:exists?|available)|has been (?:removed|deleted|moved))|temporarily unavailable"
    r"|\b(?:internal server error|server error|bad gateway|bad request|service unavailable|gateway time-?out|access denied|forbidden|not found|unauthorized|unauthorised|too many requests|request timed? ?out|invalid request)\b"
    r"|\bhttp(?:/[\d.]+)?\s*(?:error|status|code)?\s*[:#]?\s*(?:[45]\d\d|<\*>)(?!\d)|\b(?:prematurely |unexpectedly )closed\b|\bupstream\b.{0,40}\b(?:connection|connect|timed out|response)|\bgateway\b.{0,20}\b(?:response|timed out)|\bdo(?:es)? not have permission\b|\bsession (?:has )?(?:expired|timed out)|\bsign in (?:once more|again)|something went wrong|went wrong on our side|closed the connection|connection (?:was )?(?:reset|refused|closed)"
    r"|maintenance is under way|under maintenance|we will be back shortly|back shortly|try again (?:in a few|later)|slow down|unexpected error|an error (?:has )?occurred"
    r"|\bp[áa]gina\b.{0,40}\b(?:no (?:existe|se encuentra|se ha encontrado|se encontró|encontrada|está disponible))|error interno|acceso denegado|no tiene permiso|su sesión ha|sesión (?:ha )?caducad|demasiadas (?:solicitudes|peticiones)|vuelva a intentarlo|servicio no disponible|en mantenimiento|solicitud (?:no válida|incorrecta)|se ha producido un error"
    r"|\bpas (?:pu )?trouv(?:é|er) (?:ce que vous cherchez|la page|cette page)|\bno (?:hemos |se ha )?(?:podido )?encontra(?:do|r|mos) (?:lo que busca|la página)|\bnicht (?:gefunden, was|finden, was|gefunden).{0,20}\bsuchen|\b(?:could not|couldn't|can't|cannot) find what you(?:'re| are| were) looking for|\bpage demandée\b|est introuvable|erreur interne|accès (?:refusé|interdit)|merci de réessayer|veuillez réessayer|session (?:a )?expiré|trop de requêtes|service indisponible|en maintenance|vous n'avez pas (?:la permission|l'autorisation|le droit)|requête invalide|une erreur (?:est survenue|s'est produite)"
    r"|\bseite\b.{0,30}\b(?:nicht gefunden|existiert nicht|nicht verfügbar)|interner (?:server)?fehler|zugriff\b.{0,30}\b(?:verweigert|nicht erlaubt)|später erneut versuchen|sitzung\b.{0,20}abgelaufen|zu viele anfragen|wartungsarbeiten|dienst nicht verfügbar|ungültige anfrage|keine berechtigung|ein fehler ist aufgetreten"
    r"|页面不存在|服务器内部(?:出错|错误)|没有权限|登录已过期|会话已过期|请求过于频繁|请稍后(?:再试|重试)|请重新登录|拒绝访问|访问被拒绝|禁止访问|无法找到(?:该|此)?(?:页面|网页)|找不到(?:该|此|您)?.{0,4}(?:页面|网页)|网关(?:超时|错误)|系统维护|正在维护|服务不可用|无效的?请求|参数错误|图片(?:已被删除|不存在|已失效)|连接(?:已|被)(?:断开|重置|关闭)|网络(?:错误|异常)"
)
# Phrases that ask the reader to run scripts.
SCRIPT_PHRASES = re.compile(
    r"(?:enable|allow|turn on|activate|require|requires|need|needs|without|disabled|blocks?|blocking|support for|supports?)\b.{0,30}\b(?:java ?scripts?|scripts?|script support|cookies)\b|\b(?:java ?scripts?|scripts?|cookies)\b.{0,30}\b(?:disabled|required|blocked|enabled|turned off|must be|is off)"
    r"|\bbrowser\b.{0,30}\b(?:must|needs? to|has to|should)\b.{0,20}\b(?:run|execute|load|allow)\b.{0,20}\b(?:code|scripts?)\b|client-side (?:code|scripts?|scripting)|cannot (?:work|run|be (?:shown|displayed)|display|load) without .{0,20}(?:java ?script|scripts?|script support|cookies)|no-script version|checking your browser"
    r"|(?:habilit\w*|activ\w*|permit\w*|bloque\w*|necesita|requiere|sin)\b.{0,25}\b(?:java ?script|los scripts|scripts?)\b|(?:activer|activez|autoriser|autorisez|bloque|nécessite|sans|désactivé)\b.{0,25}\b(?:java ?script|les scripts|scripts?)\b"
    r"|(?:aktivieren|erlauben|blockier\w+|benötig\w+|ohne|einschalten|deaktiviert)\b.{0,25}\b(?:java ?script|skripte?|scripts?)\b|\b(?:java ?script|skripte?)\b.{0,25}\b(?:aktivieren|erlauben|einschalten|deaktiviert|blockiert)"
    r"|(?:启用|开启|打开|允许|禁用|需要|支持)[^。\n]{0,8}(?:脚本|java ?script)|(?:脚本|java ?script)[^。\n]{0,8}(?:启用|开启|打开|被禁用|功能)"
)
# What pages put around such messages.
FURNITURE = re.compile(r"(?i)^\W*(?:oops|error|sorry|home|menu|search|help|login|contact|album|gallery|image store|archive viewer|photo index|retry|go back|back to|loading|reference|request id|checking your browser|no-script|status|\(c\)|©|copyright|powered by|please wait)\b.{0,60}$|^\W*\(?\w* ?\d+(?:\W+\d+)*\W*$|^\W*$")
# Words and phrases of texts put in to fill a layout.
FILLER_PHRASES = re.compile(
    r"\blor[eu]m\b|\bipsum\b|dolor sit amet|\basdf|\bqwer|\bblah blah\b|\bfoo bar\b|\b(\w+)(?:\W+\1){2,}\b|\b([a-z])\2{2,}(?:\W+([a-z])\3{2,})+|(?:dummy|sample|placeholder|filler|example|test) (?:text|description|caption|paragraph|content|copy|image|title)|(?:caption|text|description|title|content) (?:goes|comes|will (?:go|be|come)) (?:here|added|replaced)|will be (?:replaced|added|filled in) (?:later|soon)|to be (?:replaced|written|added) later|title of the picture|line two of the title|put (?:the|your) .{0,25}\b(?:here|in this box)"
    r"|texto (?:de ejemplo|de relleno|de prueba|provisional)|para la maqueta|aquí (?:irá|va) |(?:descripción|leyenda|pie de foto|título) (?:definitiv[ao]|provisional|de ejemplo)|se (?:sustituirá|reemplazará|añadirá)|título de la imagen|\bprueba prueba"
    r"|texte (?:provisoire|d'exemple|de remplissage|factice|fictif)|pour la maquette|(?:légende|description|titre|texte) (?:définiti(?:f|ve)|provisoire) |viendra ici|sera remplacé|\bessai essai"
    r"|platzhalter|blindtext|mustertext|beispieltext|hier folgt|hier steht später|für das layout|wird (?:später )?(?:ersetzt|ergänzt|nachgereicht)|testtext"
    r"|占位|示例文字|稍后替换|测试(?:测试|文字|文本|内容|标题)|标题标题|示例(?:文本|标题|描述)|此处为|待(?:补充|替换|填写)|样例文字"
)
# The commonest function words; hardly any real sentence of these languages has none.
FUNCTION_WORDS = set(
    "the a an of in on at to and or is are was were be been by for from with without near next this that there it its you your can not no has have had one only about so while after before between behind under over who what where which how why as but if than then he she they we i my our their his her do does did will would "
    "el la los las un una unos unas de del en y o es son está están fue con sin por para al a se su sus que qué no hay como pero más muy ya lo le este esta ese esa entre sobre cerca "
    "le les l un une des du d et ou est sont était avec sans par pour au aux ce cette ces se sa son ses que qui ne pas il elle y on dans sur sous près entre plus très "
    "der die das den dem des ein eine einen einem einer und oder ist sind war wurde wird mit ohne von vom zu zum zur im in am auf an bei für es er sie nicht kein keine sich so als wie nur aus über unter neben vor nach".split()
)


def sounds_latin(message: str) -> tuple[int, int]:
    """(words, words of function) of the lower-case Latin words of a message."""
    words = re.findall(r"[^\W\d_]+", message)
    words = [w.lower() for no, w in enumerate(words) if w.isascii() or not re.match(f"[{CJK}]", w)]
    return len(words), sum(w in FUNCTION_WORDS for w in words)


# Words of servers and browsers, which pages about pictures hardly use.
SYSTEM_WORDS = set(
    "http https url browser server servers upstream gateway proxy connection connections request requests response timeout client script scripts javascript js cookie cookies session login "
    "navegador servidor conexión solicitud petición sesión navigateur serveur connexion requête session erreur error fehler verbindung anfrage sitzung".split()
)


def system_share(message: str) -> float:
    words = re.findall(r"[^\W\d_]+", message)
    return sum(w in SYSTEM_WORDS for w in words) / max(1, len(words))


def verdict(template: str, whole: int = 0) -> str | None:
    """Class of a template, judged by its founding message and by how many texts are nothing but it: error, script, filler, or None
    for content."""
    bare = re.sub(r"\s+", " ", template.replace(WILD, " ")).strip()
    spoken = _QUOTED.sub(" ", re.sub(r"\" ([^\"]*) \"", r'"\1"', bare))
    plain_words = len(re.findall(f"[^\\W\\d_{CJK}]+", spoken)) + len(re.findall(f"[{CJK}]", spoken)) / 4
    for name, p, least in (("script", SCRIPT_PHRASES, 0.22), ("error", ERROR_PHRASES, 0.4)):
        hits = [m.end() - m.start() for m in p.finditer(spoken)]
        # The phrase makes up the message; a narrative that mentions it is longer than it.
        if hits and (sum(hits) >= least * len(spoken) or plain_words <= 8):
            return name
    if re.match(r"traceback|[a-z.]*(?:error|exception) \w+error|file .* line", bare) and plain_words <= 14:
        return "error"
    found = [m.end() - m.start() for m in FILLER_PHRASES.finditer(spoken)]
    if found and (sum(found) >= 0.35 * len(spoken) or plain_words <= 6):
        return "filler"
    words = [w for w in re.findall(r"[a-zà-ÿ]+", spoken)]
    if len(words) >= 5 and not any(w in FUNCTION_WORDS for w in words) and WILD not in template and not re.search(f"[{CJK}]", spoken):
        stems = sum(bool(re.search(r"(?:um|us|am|as|at|it|et|or|is|em|en|im|ae|unt|int|tur|iq|que|quam|bam|aco|ela|tas|ris|sor|lor)$", w)) for w in words)
        if stems >= 0.6 * len(words):
            return "filler"
    if whole >= SUPPORT and system_share(spoken) >= SYSTEM_SHARE:
        return "error"
    return None


# --- The operator -----------------------------------------------------------------------------------------------------


def _table(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = Tree()

    def out() -> pa.RecordBatch:
        return _table([(leaf_of(tuple(t.split(" "))), t, *rest) for t, *rest in tree.drain()], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()], ["leaf", "template", "n", "whole", "example"])

    for b in batches:
        for text in b.column(0).to_pylist():
            said = [w for m in messages(text) if (w := masked(m))]
            for words in said:
                tree.add(words, whole=int(len(said) == 1))
            if tree.size > KEPT:
                yield out()
    yield out()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates sorted by path: mines those of each path again and classifies the result."""
    tree, last = Tree(), None

    def close() -> pa.RecordBatch:
        rows = [(leaf_of(tuple(t.split(" "))), t, n, verdict(example, whole)) for t, n, whole, example in tree.drain()]
        return _table(rows, [pa.string(), pa.string(), pa.int64(), pa.string()], ["leaf", "template", "n", "verdict"])

    for b in batches:
        for path, template, n, whole, example in zip(*(c.to_pylist() for c in b.columns)):
            if path != last:
                if tree.size > 1000:
                    yield close()
                last = path
            tree.add(tuple(template.split(" ")), n, whole, example, path)
    yield close()


def templates(documents: DataFrame) -> DataFrame:
    """(leaf, template, n, verdict) of all messages."""
    texts = spread(documents.where("text IS NOT NULL AND trim(text) <> ''").select("text"))
    local = texts.mapInArrow(_mine, "leaf string, template string, n long, whole long, example string")
    local = cut(local.groupBy("leaf", "template").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole"), F.min("example").alias("example")))
    # A leaf of a crowd of templates is divided by its next and its last word.
    crowded = local.groupBy("leaf").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select("leaf", F.lit(True).alias("crowded"))
    words = F.split("template", " ")
    path = F.when(F.col("crowded"), F.concat_ws(" | ", "leaf", F.coalesce(F.get(words, F.lit(DEPTH)), F.lit("")), F.element_at(words, -1))).otherwise(F.col("leaf"))
    local = local.join(crowded, "leaf", "left").select(path.alias("path"), "template", "n", "whole", "example")
    return local.repartition("path").sortWithinPartitions("path", F.desc("n"), "template").mapInArrow(_merge, "leaf string, template string, n long, verdict string")


#: Share of a text's content that residue must take, by class; an error in place of the rest also stands beside little text.
TAKES, BESIDE = 0.6, 160


def weight_of(message: str) -> int:
    """Short furniture around a message neither makes nor hides content."""
    return 0 if FURNITURE.match(message) and len(message) < 80 else max(len(message), 1)


def fits(template: tuple[str, ...], words: tuple[str, ...]) -> bool:
    return similarity(template, words) >= SIMILAR or all(t in (WILD, w) for t, w in zip(template, words))


class Condemned:
    """Condemned templates by leaf."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.leaves: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        self.memo: dict[tuple[str, ...], str | None] = {}
        for leaf, template, reason in rows:
            self.leaves.setdefault(leaf, []).append((tuple(template.split(" ")), reason))

    def reason(self, words: tuple[str, ...]) -> str | None:
        leaf = self.leaves.get(leaf_of(words))
        if leaf is None:
            return None
        if words not in self.memo:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[words] = min((r for t, r in leaf if fits(t, words)), default=None)
        return self.memo[words]


def takes_over(reason: str, bad: int, total: int) -> bool:
    """Does residue of this weight take the place of the content?"""
    return bad >= TAKES * total or reason in ("error", "script") and total - bad <= BESIDE


def judge(text: str, condemned: Condemned) -> str | None:
    """slot, error, script or filler, or None for content. A message said again counts once."""
    if has_slot(text):
        return "slot"
    weights: dict[tuple[str, ...], int] = {}
    for m in messages(text):
        if words := masked(m):
            weights[words] = max(weights.get(words, 0), weight_of(m))
    found = {w: r for w in weights if (r := condemned.reason(w))}
    if not found:
        return None
    reason = min(found.values())
    return reason if takes_over(reason, sum(weights[w] for w in found), sum(weights.values())) else None


def _judge(rows: list[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        condemned = Condemned(rows)
        for b in batches:
            found = [(d, r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := judge(t, condemned))]
            yield _table(found, [pa.int64(), pa.string()], ["doc_id", "reason"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, leaf, words, weight): the messages of each text without a slot; a row without words for one with a slot."""
    for b in batches:
        rows: list[tuple] = []
        for doc, row, text in zip(*(c.to_pylist() for c in b.columns)):
            if has_slot(text):
                rows.append((doc, row, None, None, 0))
            else:
                rows += [(doc, row, leaf_of(w), " ".join(w), weight_of(m)) for m in messages(text) if (w := masked(m))]
        yield _table(rows, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()], ["doc_id", "row", "leaf", "words", "weight"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [fits(tuple(t.split(" ")), tuple(w.split(" "))) for t, w in zip(b.column("template").to_pylist(), b.column("words").to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_())).select(["leaf", "words", "verdict"])


def _joined(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """What `judge` says of each text, by joins of distinct messages and condemned templates."""
    read = cut(rows.select("doc_id", F.sha2("text", 256).alias("row"), "text").mapInArrow(_read, "doc_id long, row string, leaf string, words string, weight long"))
    slots = read.where("words IS NULL").select("doc_id", F.lit("slot").alias("reason"))
    said = read.where("words IS NOT NULL").groupBy("doc_id", "row", "leaf", "words").agg(F.max("weight").alias("weight"))
    hits = said.select("leaf", "words").distinct().hint("merge").join(bad, "leaf").select("leaf", "words", "template", "verdict").mapInArrow(_match, "leaf string, words string, verdict string")
    hits = hits.groupBy("leaf", "words").agg(F.min("verdict").alias("verdict"))
    per = said.hint("merge").join(hits, ["leaf", "words"], "left").groupBy("doc_id", "row").agg(
        F.min("verdict").alias("reason"), F.sum(F.when(F.col("verdict").isNotNull(), F.col("weight")).otherwise(0)).alias("bad"), F.sum("weight").alias("total"))
    judged = per.where(F.col("reason").isNotNull() & ((F.col("bad") >= TAKES * F.col("total")) | (F.col("reason").isin("error", "script") & (F.col("total") - F.col("bad") <= BESIDE))))
    return slots.unionByName(judged.select("doc_id", "reason"))


def classify_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, reason): one row per document that is residue; reason is slot, error, script or filler."""
    bad = cut(templates(documents).where("verdict IS NOT NULL").select("leaf", "template", "verdict"))
    rows = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    condemned = bad.limit(SHIPPED + 1).collect()  # sent to all tasks if they are few, else joined; the same either way
    found = rows.mapInArrow(_judge([tuple(r) for r in condemned]), "doc_id long, reason string") if len(condemned) <= SHIPPED else _joined(rows, bad)
    return found.groupBy("doc_id").agg(F.min("reason").alias("reason"))


def residue_documents(documents: DataFrame) -> DataFrame:
    return classify_documents(documents).select("doc_id")
