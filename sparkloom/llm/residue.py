"""Problem 4: template residue, filler, error pages and script notices in place of content.

One grammar per placeholder delimiter, one expression per family of messages. Code is taken out first; a placeholder or message
that the surrounding words present as a subject (``fields such as {{x}}``, ``reports every 404 Not Found``) is taken out next.
Density decides what context leaves open: placeholders count unless the text says more about templates than it has of them, and
filler is a text whose words are nearly all those of stand-ins.

Expressions have no upper bounds; where a part may be long it is possessive or ends at its own delimiter, so that the time stays in
proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names as templates use them: words, dots, underscores, an optional filter.
_FIELD = r"[A-Za-z_][\w .\-]*+"
_HTML = r"(?:a|abbr|b|big|blockquote|body|br|button|center|cite|code|dd|del|div|dl|dt|em|figure|font|footer|form|h[1-6]|head|header|hr|html|i|img|input|ins|kbd|label|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|script|section|select|small|span|strong|style|sub|sup|svg|table|tbody|td|th|thead|title|tr|tt|u|ul|var|video|wbr)"

#: delimiter -> grammar of an unfilled placeholder in it.
GRAMMARS = {
    "braces": r"\{\{[{#/^&>!~]?\s*" + _FIELD + r"(?:\|[^{}]*+)?\}?\}\}",
    "dollar": r"\$\{\s*" + _FIELD + r"(?::[^{}]*+)?\}|\$\(" + _FIELD + r"\)",
    "hash": r"#\{\s*" + _FIELD + r"\}",
    "percent_tag": r"<%[=\-#]?\s*" + _FIELD + r"%>",
    "block": r"\{%-?\s*" + _FIELD + r"%\}",
    "brackets": r"\[\[\s*" + _FIELD + r"\]\]",
    "percent": r"%%\s*" + _FIELD + r"%%|%[A-Z][A-Z0-9]*(?:[._][A-Z0-9]+)*+%|%\([A-Za-z_]\w*\)[sd]",
    "at": r"@@\s*" + _FIELD + r"@@",
    "underscores": r"(?<![\w.])__[A-Za-z][\w.\-]*?__(?![\w(.])",
    "angle_request": r"(?i)<\s*(?:insert|enter|add|your|type|put|fill in|write|votre|ins[ée]rer)\b[^<>]*+>",
    "square_request": r"(?i)\[\s*(?:insert|enter|add|your|type|put|fill in|write|votre|ins[ée]rer|tbd|todo|placeholder)\b[^\[\]]*+\](?!\()",
    "constant": r"(?<!\w)(?:YOUR|MY|INSERT|REPLACE|ENTER)_[A-Z0-9_.]*?(?:_HERE|_NAME|_TEXT|_DESCRIPTION)(?!\w)|(?<!\w)REPLACE_?ME(?!\w)|(?<!\w)CHANGE_?ME(?!\w)",
    "task": r"(?<![\w.])(?:TODO|FIXME|TBD|XXX)\s*:\s*\S|(?<![\w.])(?:FIXME|TODO)\s+(?!(?:items?|lists?|comments?|notes?|markers?|tags?|tasks?|entries|and|or|apps?|boards?|cards?|files?|tools?)\b)[a-z][\w.]*|^\s*(?:TODO|FIXME|TBD|TBA|TBC|N/A)\b[\s.:]*$",
    "form": r"(?i)(?<!\w)(?:enter|saisir|type)\s+(?:(?!(?:enter|saisir|type)\b)[\w. ])++\((?:max|min|up to)\.?\s*\d+\s*(?:characters|chars|words|caract[èe]res)\)",
    "own_text": r"(?i)\breplace this [\w.]+(?: [\w.]+)? with (?:your|the) (?:own )?\w+|(?<!\w)votre [\w.]+(?: [\w.]+)? ici(?!\w)|^\W*(?:your|my) [\w.]+(?: [\w.]+)? (?:goes )?here\W*$|\b(?:your|my) \w+[._][\w.]+ (?:goes )?here\b",
}
#: A whole field that is nothing but a name in brackets: <long text>, [product], <description>.
BARE = r"^\s*(?:<(?!/?" + _HTML + r"\s*>)[A-Za-z][\w .\-]++>|\[[A-Za-z][\w .\-]++\]|\{[A-Za-z][\w .\-]++\}|\[object \w+\])\s*$|\[object (?:Object|Undefined|Null|Array)\]"

#: Words of the usual filler text and its imitations.
_LATIN = "lorem ipsum dolor sit amet consectetur consectetuer consec adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
#: Words that name a slot for a text, words that call it a stand-in, words that say what is to become of it.
_SLOTS = "text content description title name summary copy entry page value string api"
_STAND_INS = "placeholder dummy filler sample default example test"
_INSTRUCTIONS = "replace replaced change changed edit edited update updated remove removed fill filled add goes here please do not publish"
_LINKING = "a an and be before even for is it more of only or our own some that the then this to with your"
_KEYS = r"(?:asdf\w*|qwert\w*|sdfg\w*|hjkl|blah|bla|foo|bar|baz|xxx+|yyy+|zzz+|abc|aaa+|test|testing|string|text|sample|dummy|title|name|description|placeholder|123|\.\.\.)"
FILLER = {
    "latin": r"(?i)^\s*lorem(?: ipsum)?\b[\s.…]*$",
    "repeat": r"(?i)(?<!\w)" + _KEYS + r"(?:[\s,.]+" + _KEYS + r"){2}(?!\w)|(?<!\w)(asdf\w*|blah|xxx+|foo bar|qwerty)[\s,.]+\1(?!\w)",
    "to_complete": r"(?i)^\W*(?:(?:une? |la |le )?(?:description|texte|titre|r[ée]sum[ée]|contenu)\s+(?:[àa]\s+(?:compl[ée]ter|venir|remplir|ajouter|r[ée]diger)|non renseign[ée]e?|manquante?)|[àa] compl[ée]ter|(?:description |content |text )?coming soon|to be (?:completed|defined|announced|written|added)|no description(?: yet| available| provided)?|untitled|sans titre)\W*$|(?<!\w)(?:description|texte|contenu) [àa] compl[ée]ter(?!\w)",
    "no_value": r"(?i)^\W*(?:undefined|null|none|nan|nil|void|unknown|n/?a|error|erreur|test|todo|tbd|default|true|false)\W*$",
}

_STATUS = r"(?:Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Request Time-?out|Gone|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service (?:Temporarily )?Unavailable|Gateway Time-?out|Access Denied|Page not found|Non trouv[ée]e?|Acc[èe]s (?:refus[ée]|interdit))"
#: What sites print before their content.
_NAVIGATION = r"(?:(?:nav|menu|search|home|docs|login|log in|sign in|sign up|back|skip to (?:main )?content|accueil|connexion|aller au contenu|retour|close|about|help|contact)\b|[|☰×←→•»«/>✕=\-–—\s])"
MESSAGES = {
    "status": r"(?i)(?:^|[.!?…]\s)\s*" + _NAVIGATION + r"*+(?:(?:https?\s*)?(?:error|erreur|status|code)?[\s:#-]*[45]\d\d\s*[-–:|]*\s*" + _STATUS + r"|(?:http\s*)?(?:error|erreur)[\s:#-]*[45]\d\d\b|" + _STATUS + r"\s*[:.!]\s+(?:the|this|you|your|please|we|sorry|try)\b|" + _STATUS + r"\s*$)|^\W*(?:error|erreur)\W*\d*\W*$|^\W*[45]\d\d\W*$",
    "absent": r"(?i)\brequested (?:url|page|resource|file|document) (?:\S+ )?(?:was|could|is|does)\s?n[o']t\b|\b(?:can(?:'|no)t|could not|couldn't|unable to) (?:find|locate|display|load) (?:the|that|this) (?:page|site|content)\b|\bpage (?:you (?:are|were|requested)|that you)[^.]{0,60}(?:not|moved|removed|found|exist|looking)|\b(?:this )?page (?:does not|doesn't|no longer) exists?\b|\bcette page n['’]existe\b|\bpage (?:introuvable|non trouv[ée]e)\b|\ba [ée]t[ée] d[ée]plac[ée]e\b[^.]{0,20}erreur",
    "refused": r"(?i)\byou (?:do not|don't) have (?:the )?(?:permission|access|rights?)\b|\byou are not (?:authori[sz]ed|allowed) to\b|\baccess (?:to this (?:page|site|resource) )?(?:is|was|has been) (?:denied|blocked|forbidden)\b|\byour (?:session|login|link) (?:has )?(?:expired|timed out)\b|\bvotre session a expir[ée]\b|\bplease (?:sign|log) in (?:again )?to (?:continue|proceed|view)\b|\byour (?:ip|ip address|request|access) (?:has been|was|is) (?:blocked|denied|banned)\b|\btoo many requests\b[.!:]\s*(?:please |kindly )?[a-z]+ (?:\w+ )?(?:again|and|before|for|in|later|until)\b|\bacc[èe]s (?:refus[ée]|interdit)\b[.!:]",
    "failing": r"(?i)\b(?:please )?try again (?:later|in a (?:few|moment))\b|\br[ée]essayez? (?:plus tard|ult[ée]rieurement)\b|\bserver (?:could not|cannot|is unable to|was unable to|encountered)\b[^.]{0,40}\b(?:request|error)\b|\bsomething went wrong\b|\ban (?:unexpected |internal )?error (?:has )?occurred\b|\bune erreur (?:est survenue|s'est produite)\b|\bdown for (?:scheduled )?maintenance\b|\b(?:under|en cours de|site en) maintenance\b[.!]|\bdomain (?:name )?(?:is|has been) (?:parked|for sale|suspended|expired)\b|\bdomaine? est (?:[àa] vendre|en parking|r[ée]serv[ée])\b|\baccount (?:has been )?suspended\b|\bcontact (?:the|your) (?:web)?(?:site )?administrator\b|\b(?:ray|request|reference) (?:id )?#?[0-9a-f]{6,}\b",
    "trace": r"Traceback \(most recent call last\)|\b(?:Uncaught|Unhandled) (?:\w*Error|\w*Exception|rejection|exception)\b|cannot read propert(?:y|ies) of (?:undefined|null)|\bException in thread \"|\bat [\w.$]+\([\w]+\.java:\d+\)|\b(?:Fatal|Parse|Syntax) error: |\bundefined (?:index|variable|method|offset)\b|\bKeyError: '|\bNullPointerException\b|\bWarning: \w+\(\)|\bSQLSTATE\[",
    "challenge": r"(?i)\bchecking (?:your|the) browser\b|\bv[ée]rification de votre navigateur\b|\bverify(?:ing)? (?:that )?you(?:'re| are)? (?:a )?(?:not a robot|human)\b|\bprove (?:that )?you(?:'re| are) (?:a )?(?:not a robot|human)\b|\bv[ée]rifi\w+ que vous (?:[êe]tes (?:un )?humain|n['’][êe]tes pas un robot)\b|\bcomplete the (?:security check|captcha)\b|\bone more step\b\s*[:.!]|\bcaptcha to (?:continue|proceed)\b|\bthis may take a few seconds\b|\bi am not a robot\b|\bjust a moment\s*\.\.\.",
}

_SCRIPTS = r"(?:java\s?script|js|scripts?|scripting|active content|cookies|les scripts|le javascript|les cookies)"
_SWITCH = r"(?:enabl(?:e|ing)|allow(?:ing)?|activat(?:e|ing)|turn(?:ing)? on|switch(?:ing)? on|permit(?:ting)?|unblock(?:ing)?|activer|activez(?:-le)?|autoriser|autorisez|d[ée]bloquer)"
NOTICES = {
    "switch_on": r"(?i)\b" + _SWITCH + r"\s+(?:the\s+|your\s+|browser\s+)?" + _SCRIPTS + r"(?!\w)",
    "needed": r"(?i)(?:^|[.!?…|☰×←:]\s*|\bcontent\s+|\bsearch\s+|\bback\s+|\blogin\s+)(?:sorry,? )?(?:the|this|our|ce|cette|le|la|l['’])\s*(?:\w+\s){0,2}?\w+ (?:requires?|relies on|needs?|depends on|n[ée]cessite|requiert|a besoin de|uses)\s+(?:the\s+|de\s+)?" + _SCRIPTS + r"(?:\s+and\s+" + _SCRIPTS + r")?\s*(?:to\b[^.]{0,40}|in\b[^.]{0,40}|pour\b[^.]{0,40}|;[^.]{0,60})?\s*(?:[.!…]|$)",
    "without": r"(?i)\b(?:cannot|can't|can not|could not|won't|will not|does not|doesn't|unable to) (?:be (?:shown|displayed|viewed|used|loaded|rendered)|work|run|load|display|function)(?: properly| correctly)? without (?:\w+\s)?" + _SCRIPTS + r"|\bwithout " + _SCRIPTS + r"[^.]{0,30}\b(?:cannot|nothing|not)\b",
    "off": r"(?i)\b" + _SCRIPTS + r" (?:is|are|est|sont|seem to be|seems to be|appears? to be) (?:currently )?(?:off|disabled|blocked|switched off|turned off|d[ée]sactiv[ée]s?|bloqu[ée]s?)\b|\bbrowser does(?: not|n't) support (?:" + _SCRIPTS + r"|frames|this)|\bnavigateur ne (?:supporte|prend)|<noscript>|\bif nothing happens, (?:allow|enable|reload|click)",
}

#: Fenced and inline code.
CODE = r"(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)|`[^`\n]+`"
#: Grammars of delimiters, which honest texts about templates use as well; grammars of words alone.
DELIMITED, WORDED = ("braces", "dollar", "hash", "percent_tag", "block", "brackets", "percent", "at"), ("form", "own_text")
_ANY_PLACEHOLDER = "(?:" + "|".join(GRAMMARS[k] for k in DELIMITED) + ")"
#: Placeholders that the sentence around them speaks about.
SPOKEN_OF = (
    r"(?i:\b(?:such as|like|e\.g\.,?|for example,?|for instance,?|for every|of the form|written as|comme|par exemple)\s+(?:\w+\s)?)" + _ANY_PLACEHOLDER
    + r"|(?i:\b(?:substitut\w*|replac(?:es|ing)|expand(?:s|ing)|resolv(?:es|ing)|interpolat\w*|render(?:s|ing)|fill(?:s|ing)(?: in)?|pars(?:es|ing)|finds|detects)\s+(?:\w+\s){0,2}?)" + _ANY_PLACEHOLDER
    + "|" + _ANY_PLACEHOLDER + r"(?i:[\"']?\s+(?:references?|variables?|placeholders?|expressions?|syntax|tags?|markers?|(?:is|are|gets?|will be) (?:filled|replaced|substituted|expanded|resolved|rendered)))"
)
#: Messages and filler that the sentence around them speaks about: the sentence is about detecting, making or testing them.
_ABOUT = r"(?:detect|monitor|report|track|log|alert|return|generat|produc|test|simulat|try|find|flag|catch|classif|list|count|watch|render|handl|d[ée]tect|surveill|g[ée]n[èe]r)\w*"
_ABOUT_START = r"(?i)(?<![\w])" + _ABOUT + r"(?!\w)"
#: What such a sentence says of them, behind that.
_KINDS_OF = r"(?i)\b(?:every|each|such as|like|all|failures?|style|error pages?|parked domains?|placeholder text|answers?|filler|that need|when|toutes?|chaque)\b"
#: Beginnings of words by which a text speaks about templates.
_TEMPLATING = r"(?i)(?<!\w)(?:templat|placeholder|substitut|interpolat|render|variable|expression|syntax|token|merge field|mail merge|expand|mustache|handlebars|pars(?:e|er|ing))\w*"


def is_repetition(words: Column) -> Column:
    """True where ``words`` are one to three words said over and over, two times at least."""
    unit = F.array_distinct(words)
    times = F.floor(F.size(words) / F.size(unit)).cast("int")
    return (F.size(unit) >= 1) & (F.size(unit) <= 3) & (times >= 2) & (F.array_join(words, " ") == F.rtrim(F.repeat(F.concat(F.array_join(unit, " "), F.lit(" ")), times)))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _run(words: Column, of: str, n: int) -> Column:
    """True where ``n`` words in a row are among ``of``."""
    marks = F.array_join(F.transform(words, lambda w: F.when(w.isin(of.split()), "1").otherwise("0")), "")
    return F.contains(marks, F.lit("1" * n))


def is_stand_in(words: Column) -> Column:
    """True where a text is nothing but a stand-in for one: four of five words or more are those of slots, stand-ins, instructions and
    linking words, and a slot is called a stand-in or said to be filled; or slots are half of its words, said over and over."""
    among = lambda *lists: F.size(F.filter(words, lambda w: w.isin([x for l in lists for x in l.split()])))
    slots, stand_ins, told = among(_SLOTS), among(_STAND_INS), among(_INSTRUCTIONS)
    share = among(_SLOTS, _STAND_INS, _INSTRUCTIONS, _LINKING) / F.size(words)
    first = F.element_at(words, 1)
    opens = first.isin((_SLOTS + " " + _STAND_INS + " some this the a replace").split())
    distinct = F.size(F.array_distinct(F.filter(words, lambda w: w.isin(_SLOTS.split()))))
    stated = (share >= 0.8) & opens & (slots > 0) & ((stand_ins > 0) | (told > 1)) & (F.size(words) >= 2)
    return F.coalesce(F.when(F.size(words) > 0, stated | ((slots * 2 >= F.size(words)) & (slots >= 4) & (slots >= 3 * distinct))), F.lit(False))


def untold(text: Column) -> Column:
    """``text`` without the sentences that are about messages or filler, of any length."""
    sentences = F.split(text, r"(?<=[.!?])\s+|(?<=…)")
    # What follows the first word of detecting, making or testing decides; one pass over each sentence.
    rest = lambda s: F.regexp_extract(s, _ABOUT_START + r"(?s)(.*)$", 1)
    return F.array_join(F.filter(sentences, lambda s: ~rest(s).rlike(_KINDS_OF)), " ")


def placeholder_share(text: Column) -> Column:
    """Characters of unfilled placeholders in ``text``."""
    return F.length(text) - F.length(F.regexp_replace(text, _ANY_PLACEHOLDER, ""))


def templating_share(text: Column) -> Column:
    """Characters of words in ``text`` that speak about templates."""
    return F.length(text) - F.length(F.regexp_replace(F.regexp_replace(text, _ANY_PLACEHOLDER, " "), _TEMPLATING, "")) - placeholder_share(text) + F.regexp_count(text, F.lit(_ANY_PLACEHOLDER))


#: Signs of which a placeholder in delimiters or capitals has one.
_SIGNS = ["{", "$", "#", "%", "@", "<", "[", "_", "TODO", "FIXME", "TBD", "TBA", "TBC", "N/A", "XXX", "REPLACE", "CHANGE"]
_SCRIPT_WORDS = "java javascript js script scripts scripting active cookies"
#: pattern -> words of which every text that matches it has one. Most texts have none, and the pattern is not tried on them.
NEEDED = {
    "form": "enter saisir type", "own_text": "replace votre your my", "to_complete": "complete completed compléter completer venir remplir ajouter rédiger rediger renseigné renseignée renseigne renseignee manquante manquant coming defined announced written added description untitled titre",
    "status": "bad unauthorized payment forbidden found allowed timeout time gone many internal implemented gateway unavailable denied trouvé trouvée trouve trouvee refusé refuse interdit error erreur",
    "absent": "requested page find locate display load erreur", "refused": "have authorized authorised allowed denied blocked forbidden expired timed expiré expire sign log banned many refusé refuse interdit",
    "failing": "again réessayez réessaye reessayez reessaye server wrong occurred erreur maintenance domain domaine suspended administrator webadministrator ray request reference", "trace": "traceback uncaught unhandled properties property exception java fatal parse syntax undefined keyerror nullpointerexception warning sqlstate",
    "challenge": "browser navigateur human humain robot captcha security step seconds moment", "switch_on": _SCRIPT_WORDS, "needed": _SCRIPT_WORDS, "without": _SCRIPT_WORDS, "off": _SCRIPT_WORDS + " browser navigateur noscript nothing",
    "repeat": "blah bla foo bar baz abc test testing string text sample dummy title name description placeholder 123",
}


def _has(words: Column, key: str) -> Column:
    """Whether the pattern ``key`` can match a text of these words."""
    known = NEEDED[key].split()
    if key == "status":  # a number or a word that runs into one: 404, error404
        return F.exists(words, lambda w: w.isin(known) | ((F.length(w) == 3) & F.substring(w, 1, 1).isin("4", "5")) | F.startswith(w, F.lit("err")))
    if key == "repeat":  # runs of keys and of single letters
        return F.exists(words, lambda w: w.isin(known) | F.substring(w, 1, 3).isin("asd", "qwe", "sdf", "hjk", "xxx", "yyy", "zzz", "aaa"))
    return F.exists(words, lambda w: w.isin(known))


def residue_kinds(text: Column) -> Column:
    """Sorted kinds of residue in ``text`` (``placeholder:braces``, ``filler:latin``, ``message:status``, ``notice:off`` ...); empty where there is none.

    Null and empty texts, and texts that are merely short or cut, have none. Code blocks and placeholders or messages that a
    sentence speaks about do not count; nor do placeholders in delimiters in a text that has more characters in words about templates
    than in placeholders. The whole text is searched, whatever its length.
    """
    signs = F.lit(False)
    for sign in _SIGNS:
        signs = signs | F.contains(text, F.lit(sign))
    prose = F.when(F.contains(text, F.lit("`")) | F.contains(text, F.lit("~~~")), F.regexp_replace(text, CODE, " ")).otherwise(text)
    unspoken = F.when(signs, F.regexp_replace(prose, SPOKEN_OF, " ")).otherwise(prose)

    def tried(x: Column, of: Column, key: str, pattern: str) -> Column:
        return (_has(x.words, key) & of.rlike(pattern)) if key in NEEDED else of.rlike(pattern)

    def kinds(x: Column) -> Column:
        found = [
            *[F.when(tried(x, x.unspoken, k, p) if k in WORDED else x.signs & x.unspoken.rlike(p) & (~x.about if k in DELIMITED else F.lit(True)), F.lit(f"placeholder:{k}")) for k, p in GRAMMARS.items()],
            F.when(x.signs & x.unspoken.rlike(BARE), F.lit("placeholder:bare")),
            *[F.when((tried(x, x.unspoken, k, p) | F.contains(x.unspoken, F.lit("...")) & x.unspoken.rlike(p)) if k == "repeat" else tried(x, x.unspoken, k, p), F.lit(f"filler:{k}")) for k, p in FILLER.items()],
            F.when(_run(x.words, _LATIN, 5), F.lit("filler:latin")),
            F.when(is_stand_in(x.words), F.lit("filler:stand_in")),
            F.when(is_repetition(x.words), F.lit("filler:repetition")),
            *[F.when(tried(x, x.told, k, p), F.lit(f"message:{k}")) for k, p in MESSAGES.items()],
            *[F.when(tried(x, x.unspoken, k, p), F.lit(f"notice:{k}")) for k, p in NOTICES.items()],
        ]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))

    def told(x: Column) -> Column:
        """A message keeps its sentence unless the sentence is about messages."""
        any_ = F.lit(False)
        for k in MESSAGES:
            any_ = any_ | _has(x.words, k)
        return F.struct(x.unspoken.alias("unspoken"), x.words.alias("words"), x.signs.alias("signs"), x.about.alias("about"), F.when(any_, untold(x.unspoken)).otherwise(x.unspoken).alias("told"))

    # The cleaned texts and their words are bound once per row: inside every test they would be made again for each of them.
    about = lambda u: F.when(signs, templating_share(u) > placeholder_share(u)).otherwise(F.lit(False))
    cleaned = F.transform(F.array(unspoken), lambda u: F.struct(u.alias("unspoken"), _words(u).alias("words"), signs.alias("signs"), about(u).alias("about")))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.element_at(F.transform(F.transform(cleaned, told), kinds), 1))


def placeholder_density(text: Column) -> Column:
    """Share of the characters of ``text`` outside code that unfilled placeholders cover which no sentence speaks about; 0 for null and empty texts."""
    prose = F.regexp_replace(text, CODE, " ")
    return F.when(F.length(prose) > 0, placeholder_share(F.regexp_replace(prose, SPOKEN_OF, " ")) / F.length(prose)).otherwise(F.lit(0.0))
