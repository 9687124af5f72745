"""Problem 9: personal information in free text.

Regular expressions propose spans of e-mail addresses, telephone and identity numbers, street
addresses and names. Validators (Luhn, mod 97, mod 23, ISO 7064, the date-free national
checksums) raise the score of a span, so do words near it that announce its kind; words that announce other
numbers (builds, orders, ISBNs, ticks) lower it. Spans at or above a threshold are kept; where spans
overlap, the more exact kind wins. Placeholders such as [EMAIL] replace them.

Given and family names are learned from the corpus: the parts of e-mail addresses such as
given.family@host, counted over all texts with pre-aggregation. They add to the score of a name; a name that no list holds is found by what announces it,
what follows it, or an address in its line. The `max_names` most frequent
entries (about 30 MB at the default) go to the workers; the rest of the list, where there is one,
stays a table, and each text gets those of its entries that it holds, so that every entry counts.

No shuffle besides that count and, beyond `max_names`, that join; each text is one row of an Arrow pass.

Defined results: null and empty texts have no spans and stay as they are; repeated rows give their
spans again.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import Both, free_name, map_lists
from docloom.session import cut

KINDS = ("email", "id_number", "phone", "address", "name")
THRESHOLD = 0.6

# ---- e-mail -------------------------------------------------------------------------------------
_AT = r"(?:[@＠]|\(at\)|[ ]?\[at\][ ]?|[ ]AT[ ])"
_DOT = r"(?:\.|[ ]?\[dot\][ ]?|[ ]DOT[ ]|\(dot\))"
_EMAIL = re.compile(rf"(?<![\w.%+/{{}}@-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}(?![\w@-])")
_EMAIL_SIGNS = ("@", "＠", "(at)", "[at]", " AT ")
_EMAIL_SIGN = re.compile(r"[@＠]|[(\[]at[)\]]|[ ]AT[ ]")

# ---- telephone ----------------------------------------------------------------------------------
_PHONES = (
    r"\+1[-. ]?(?:\(\d{3}\)[ ]?|\d{3}[-. ]?)\d{3}[-. ]?\d{4}",  # North America
    r"1[-. ]\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}",
    r"\(\d{3}\)[ ]?\d{3}[-. ]\d{4}",
    r"\d{3}([-.])\d{3}\1\d{4}",
    r"(?:\+44[ -]?(?:\(0\)[ ]?)?|0044[ -]?|0)\d{4}[ -]?\d{3}[ -]?\d{3}",  # United Kingdom
    r"(?:\+44[ -]?(?:\(0\)[ ]?)?|0044[ -]?|0)\d{2,3}[ -]\d{3,4}[ -]\d{4}",
    r"(?:\+33|0033)[ .]?(?:\(0\)[ ]?)?\d(?:[ .-]?\d{2}){4}",  # France
    r"0\d(?:([ .-])\d{2})(?:\2\d{2}){3}",
    r"(?:\+34|0034)[ -]?\d{3}[ -]?\d{3}[ -]?\d{3}",  # Spain
    r"(?:\+7|8)[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}",  # Russia
    r"(?:\+86|\+81|\+82)[ -]?(?:\(0\)[ ]?)?\d{1,3}[ -]?\d{4}[ -]?\d{4}",  # East Asia
    r"0\d{1,3}-\d{4}-\d{4}",
    r"(?:\+49|0049)[ ]?(?:\(0\)[ ]?|\(0?\d{2,4}\)[ ]?)?\d{2,5}[ /-]{0,3}\d{3,8}(?:[ -]\d{1,4})?",  # Germany
    r"\(0\d{2,4}\)[ ]?\d{4,8}(?:[ -]\d{1,4})?",
    r"0\d{2,4}[ ]?/[ ]?\d{4,8}(?:[ -]\d{1,4})?",
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}[ .-]?\d{2,4}",  # any other country
    r"\d{3}([ -])\d{3}\3\d{3}",  # three groups of three: only where a word announces it
)


def _number_groups(patterns: tuple[str, ...]) -> re.Pattern:
    """One pattern with a named group for each; back-references are renumbered."""
    parts, group = [], 0
    for i, p in enumerate(patterns):
        inner = re.compile(re.sub(r"\\[123]", ".", p)).groups
        parts.append(f"(?P<k{i}>" + re.sub(r"\\[123]", lambda m, g=group: f"\\{g + 2}", p) + ")")
        group += 1 + inner
    return re.compile(r"(?<![\w.+/#@-])(?<!\d[ -])(?:" + "|".join(parts) + r")(?![\w/@:-]|[.]\d)")


_PHONE = _number_groups(_PHONES)
_WEAK_PHONES = {f"k{len(_PHONES) - 1}"}
_PHONE_CUE = re.compile(
    r"(?:tel|tél|tfno|phone|fax|call|mobile|handy|number|ring me|on-call|llame|appelez|anrufen|bei ausfall|звоните|тел|電話|电话|拨打|连絡|連絡|☎|📞|هاتف|फ़ोन|โทร)[^\n\d]{0,24}$", re.I
)
_ROW_CUE = re.compile(r"[|;·\t,][ ]?$")
_OTHER_NUMBER = re.compile(r"\b(?:build|order code|isbn|issue #?|commit|version|port|listens on|sizes are)[\s:#\d.,x-]{0,14}$", re.I)
_OTHER_AFTER = re.compile(r"^[ ]?(?:ticks|bytes|covers|seats|%|ms\b)", re.I)

# ---- identity numbers ---------------------------------------------------------------------------
_ID_CUE = re.compile(
    r"ssn|social security|taxpayer|itin|nino|national insurance|ni number|insurance no|assuré|\bnir\b|sécurité sociale|documento|\bdni\b|\bnie\b|\bnif\b|idnr|steuer|"
    r"identit|identifikation|passport|aadhaar|身份|证件|個人番号|マイナンバー|снилс|инн|паспорт|आधार|الهوية|บัตรประชาชน|personal id|national id|\bcpf\b|codice fiscale|\bbsn\b|pesel",
    re.I,
)
_IDS = (
    ("ssn", r"\d{3}-\d{2}-\d{4}"),
    ("ssn_plain", r"\d{3} \d{2} \d{4}|\d{9}"),
    ("nino", r"[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]"),
    ("nir", r"[12][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{2}"),
    ("dni", r"\d{8}[- ]?[A-Z]|\d{2}\.\d{3}\.\d{3}[- ]?[A-Z]|[XYZ][- ]?\d{7}[- ]?[A-Z]"),
    ("idnr", r"\d{2} \d{3} \d{3} \d{3}|\d{11}"),
    ("cn", r"\d{17}[\dXx]"),
    ("snils", r"\d{3}-\d{3}-\d{3}[ -]\d{2}"),
    ("twelve", r"\d{4}([ -]?)\d{4}[ -]?\d{4}"),
)
#: Six digits and more with their separators: only around these are numbers looked for.
_DIGITS = re.compile(r"\d[\d ().\-/]{4,}[\dXx]")
_ID = re.compile(r"(?<![\w.+/#@-])(?<!\d[ -])(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _IDS) + r")(?![\w/@-]|[.]\d|[ ]\d)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """The key of a French insurance number: the last two digits complete the rest to 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def mod23(text: str) -> bool:
    """The letter of a Spanish identity number."""
    body = re.sub(r"[-. ]", "", text)
    if body[0] in "XYZ":
        body = "XYZ".index(body[0]).__str__() + body[1:]
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(body[:-1]) % 23] == body[-1]


def iso7064(digits: str) -> bool:
    """ISO 7064 mod 11,10, the check digit of a German tax identification number."""
    product = 10
    for c in digits[:-1]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def resident_checksum(text: str) -> bool:
    """The last place of a Chinese resident identity number."""
    weights = [2 ** (17 - i) % 11 for i in range(17)]
    return "10X98765432"[sum(int(c) * w for c, w in zip(text, weights)) % 11] == text[17].upper()


def _id_score(kind: str, text: str) -> float:
    digits = re.sub(r"\D", "", text)
    if kind == "ssn":
        return 0.6
    if kind == "nino":
        return 0.7
    if kind == "nir":
        return 0.6 if mod97(digits) and " " in text else 0.3 + 0.2 * mod97(digits)
    if kind == "dni":
        return 0.3 + 0.2 * mod23(text)
    if kind == "idnr":
        return 0.2 + 0.2 * iso7064(digits)
    if kind == "cn":
        return 0.3 + 0.4 * resident_checksum(text)
    if kind == "snils":
        return 0.5
    return 0.2 + 0.1 * luhn(digits)


# ---- addresses ----------------------------------------------------------------------------------
_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
_CAP = rf"[{_UP}][\w'’-]*"
_GAP = r"(?:,?[ ]|,?[ ]?\n[ ]?)"
_EN_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Way|Terrace|Crescent|Square|Sq|Place|Pl|Row|Gardens|Grove|Hill|Parkway|Pkwy|Highway|Hwy|Mews|Walk|Quay)\b\.?"
_EN = rf"\d{{1,5}}[A-Za-z]?,?[ ](?:{_CAP}[ ]){{1,3}}?{_EN_STREET}(?:{_GAP}(?:Apt\.?|Apartment|Suite|Ste\.?|Unit|Flat|Floor|#)[ ]?\w{{1,5}})?"
_EN_TOWN = rf"{_GAP}{_CAP}(?:[ ]{_CAP}){{0,2}}{_GAP}(?:[A-Z]{{1,2}}\d[A-Z\d]?[ ]\d[A-Z]{{2}}|[A-Z]{{2}}[ ]\d{{5}}(?:-\d{{4}})?)"
_DE_BEFORE = r"(?:Am|Im|An der|An den|In der|In den|Zum|Zur|Auf der|Auf dem|Auf den|Hinter der|Hinter dem|Unter den|Vor dem)"
_DE = rf"(?:{_DE_BEFORE}[ ]{_CAP}[ ]\d{{1,4}}[ ]?[a-z]?\b|(?:{_CAP}[ ])?[{_UP}][\w-]*?(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|steig|pfad|chaussee)[ ]\d{{1,4}}[ ]?[a-z]?\b)"
_DE_TOWN = rf"{_GAP}(?:D-)?\d{{5}}[ ]{_CAP}(?:[ ](?:am|an der|an|bei|im|in der|ob der|vor der|auf der)[ ]{_CAP}|[ ]{_CAP}(?=[\s,;|·.]|$))?"
_FR = rf"\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[a-d]))?,?[ ](?:rue|avenue|av\.|bd|boulevard|chemin|allée|place|impasse|quai|cours|route|square|ruelle|passage|faubourg)[ ](?:de la |de l['’]|du |des |de |d['’]|la |le |les )?{_CAP}(?:[ ](?:de la |du |des |de |d['’])?{_CAP}){{0,2}}"
_FR_TOWN = rf"{_GAP}\d{{5}}[ ]{_CAP}(?:[ ](?:sur|sous|en|les|lès|la|le|de|du)[ ]{_CAP}|[ ]Cedex)?"
_ES = rf"(?:[Cc]/|[Cc]alle|[Aa]vda\.?|[Aa]v\.|[Aa]venida|[Pp]laza|[Pp]za\.|[Pp]l\.|[Pp]aseo|[Pp]\.º|[Cc]amino|[Rr]onda|[Tt]ravesía)[ ]?(?:de la |de las |de los |del |de |la )?{_CAP}(?:[ ](?:de la |del |de )?{_CAP}){{0,2}},?[ ](?:n\.º[ ]?)?\d{{1,4}}(?:,[ ]\d{{1,2}}\.?[ºª][ ]?\w?)?"
_ES_TOWN = rf"{_GAP}\d{{5}}[ ]{_CAP}(?:[ ](?:de la |del |de |la |el ){_CAP}|[ ]{_CAP}(?=[\s,;|·.]|$))?"
#: Each pattern is tried only within a window around its sign.
_ADDRESSES = tuple((re.compile(rf"(?<![\w/.,-]){a}({t})?"), need) for a, t, need in ((_EN, _EN_TOWN, 0.3), (_FR, _FR_TOWN, 0.3), (_DE, _DE_TOWN, 0.3), (_ES, _ES_TOWN, 0.3)))
_EN_SIGN = re.compile(rf"\d[A-Za-z]?,?[ ][{_UP}][^\n,;|]{{2,40}}?[ ]{_EN_STREET}")
_FR_SIGN = re.compile(r"\d(?:[ ]?(?:bis|ter|quater|[a-d]))?,?[ ](?:rue|avenue|av\.|bd|boulevard|chemin|allée|place|impasse|quai|cours|route|square|ruelle|passage|faubourg)[ ]")
_DE_ENDS = ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ring", "damm", "ufer", "steig", "pfad", "chaussee")
_DE_SIGN = re.compile(rf"\b{_DE_BEFORE}[ ][{_UP}][\w-]*[ ]\d")
_DE_WORDS = ("Am ", "Im ", "An de", "In de", "Zum ", "Zur ", "Auf de", "Hinter de", "Unter den ", "Vor dem ")
_ES_WORDS = ("C/", "c/", "alle ", "vda", "Av.", "av.", "venida", "laza", "za.", "Pl.", "pl.", "aseo", "P.º", "amino", "onda", "raves")
_ES_SIGN = re.compile(r"[Cc]/|[Cc]alle[ ]|[Aa]vda|[Aa]v\.|[Aa]venida|[Pp]laza|[Pp]za|[Pp]l\.|[Pp]aseo|[Pp]\.º|[Cc]amino|[Rr]onda|[Tt]ravesía")
_EN_WORDS = (" Street", " St", " Road", " Rd", " Lane", " Ln", " Close", " Ave", " Boulevard", " Blvd", " Dr", " Court", " Ct", " Way", " Terrace", " Crescent", " Sq", " Pl", " Row", " Gardens", " Grove", " Hill", " Parkway", " Pkwy", " Highway", " Hwy", " Mews", " Walk", " Quay")
_FR_WORDS = (" rue ", " avenue ", " av. ", " bd ", " boulevard ", " chemin ", " allée ", " place ", " impasse ", " quai ", " cours ", " route ", " square ", " ruelle ", " passage ", " faubourg ")


def _address_signs(text: str, k: int):
    """Where an address of the k-th form may be, as (start, end) of a sign of it."""
    if k == 2:
        for end in _DE_ENDS:
            at = text.find(end + " ")
            while at >= 0:
                at += len(end)
                if text[at + 1 : at + 2].isdigit():
                    yield at, at + 2
                at = text.find(end + " ", at)
        if any(w in text for w in _DE_WORDS):
            for m in _DE_SIGN.finditer(text):
                yield m.start(), m.end()
    elif any(w in text for w in (_EN_WORDS, _FR_WORDS, (), _ES_WORDS)[k]):
        for m in (_EN_SIGN, _FR_SIGN, None, _ES_SIGN)[k].finditer(text):
            yield m.start(), m.end()


_ADDRESS_CUE = re.compile(r"(?:address|adresse|anschrift|dirección|direccion|office|ship(?:ped)?(?:_| )to|moved to|lives at|wohnt|habite|vive en|deliver)[^\n]{0,12}$", re.I)

# ---- names --------------------------------------------------------------------------------------
_PARTICLE = r"(?:(?:van der|van den|van de|van|von|de la|de|del|der|di|da|du|le|la|ten|ter|bin|al|VAN DER|VAN DE|VAN|VON|DE LA|DE|DEL|DER|DI|DA|DU)[ ])"
_ONE = rf"(?:[{_UP}]['’])?(?:Mc|Mac)?[{_UP}](?:[{_LOW}]+|[{_UP}]+)"
_FAMILY = rf"{_PARTICLE}?{_ONE}(?:-{_PARTICLE}?{_ONE})?(?![\w(]|\.\w)"
_GIVEN = rf"[{_UP}](?:[{_LOW}]+|[{_UP}]+)(?:-[{_UP}](?:[{_LOW}]+|[{_UP}]+))?"
_INITIALS = rf"(?:[{_UP}]\.[ ]?){{1,2}}"
_GIVEN_AT = re.compile(rf"{_GIVEN}(?![\w(]|\.\w)")
#: What may not stand before a name.
_JOINED = set("@.'’/-_")
_AFTER_GIVEN = re.compile(rf"(?:[ ]|[ ]{_INITIALS})({_FAMILY})")
_BEFORE_GIVEN = re.compile(rf"(?<![\w@.'’/-])({_FAMILY}),[ ]$")
_MIDDLE = re.compile(rf"[ ][{_UP}]\.(?=[\s,;|·)]|$)")
_INITIAL_SIGN = re.compile(rf"[{_UP}]\.")
_INITIAL_AT = re.compile(rf"((?:[{_UP}]\.[ ]?){{1,2}})({_FAMILY})")
_NAME_CUE = re.compile(
    r"(?:hi|hello|hallo|dear|cc|owner:|reviewer = \"|thanks to|signed-off-by:|reported by:?|@author|author:|maintainer:|--|as|was|that|by|from|contact:?|danke an|gemeldet von|merci à|signalé par|gracias a|reportado por|informó|name:)[ ]?$", re.I
)
_NAME_AFTER = re.compile(r"^(?:, could you| asked | wrote | said | \(maintainer\)|\"|, bitte|[ ]?[|;·\t]|\n|$)")
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|M|Mme|Sr|Sra|Señor|Señora|Monsieur|Madame)\.?[ ])?"
#: What announces a name whatever the learned lists hold, from the surest on.
_CUES = (
    (0.5, re.compile(rf"(?:(?<!\w)(?:hi|hello|hallo|bonjour|hola|dear|cc)|owner:|reviewer = \"|(?:signed-off|reviewed|acked|tested|co-authored)-by:|(?<!\w)(?:reported|written|reviewed) by:?|author:?|maintainer:|(?:gemeldet|geschrieben) von|signalé par|écrit par|(?:reportado|informado|escrito) por|informó|(?<!\w)name:)[ ]?{_TITLE}$", re.I)),
    (0.4, re.compile(rf"(?:(?<![\w-])--|(?<!\w)(?:thanks to|danke an|merci à|gracias a|contact:))[ ]{_TITLE}$", re.I)),
    (0.2, re.compile(rf"(?<!\w)(?:as|was|that|by|from|von|par|por|contact)[ ]{_TITLE}$", re.I)),
)
_CLOSING = re.compile(r"(?:regards|sincerely|cheers|thanks|best wishes|grüßen|grüße|cordialement|salutations|saludos|atentamente),?[ ]?\r?\n[ ]?$", re.I)
#: What only follows a person, what mostly does, and what ends a line or field.
_PERSON_AFTER = re.compile(r"(?:, (?:could|can|would) you| (?:asked|said|wrote|replied|suggested)\b| \(maintainer\)|, pouvez-|, bitte|, ¿)")
_SAID_AFTER = re.compile(r"(?: (?:rewrote|fixed|reported|noticed|who)\b)")
_THANKED_FOR = re.compile(r"[ ](?:for|für|pour|por)\b")
_ENDS_AFTER = re.compile(r"[ ]?(?:[|;·\t\r\n]|$)|[,\"]")
_MADE = re.compile(r"(?:Mc|Mac|[A-Z]['’])[A-ZÀ-Þ]|[a-z]|(?:VAN|VON|DE|DER|DI|DA|DU|DEL)[ ]")
# Words in capitals beside a cue that make a title, a group or a firm of it.
_NO_NAME = frozenset(
    "hi hello hallo bonjour hola dear cc reported signed written author maintainer owner all the this that these those our your my you we they it a an and or not for with from to in on at by as if when where what who no new please thanks see use read run each every any some one two "
    "dr prof mr mrs ms herr frau mme sr sra señor señora monsieur madame sir "
    "team teams group groups crew committee council board staff department office division unit support sales service services help desk helpdesk project projects foundation association society institute university "
    "college school company corporation corp inc ltd llc gmbh ag sa sl sarl plc bank labs lab software systems solutions technologies tools community developers developer maintainers maintainer authors author users user "
    "contributors contributor reviewers reviewer editors editor admin administrator administrators release releases security documentation docs engineering operations platform infrastructure research design quality customer customers "
    "network server client database data index session engine version build error guide manual street road avenue lane january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday mondays tuesdays wednesdays thursdays fridays saturdays sundays der die das ein eine und le la les un une et el los las y".split()
)
_CYR = re.compile(r"(?<![\w-])[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?[ ][А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?:[ ][А-ЯЁ][а-яё]+)?(?![\w-])|(?<![\w-])(?:[А-ЯЁ]\.[ ]?){1,2}[А-ЯЁ][а-яё]+(?![\w-])")
_CYR_CUE = {"Сообщил", "Сообщила", "Спасибо", "Автор", "Пишет", "Привет", "Прислал", "Прислала", "Написал", "Написала", "Проверил", "Проверила"}
_HAN = "一-鿿々"
_CJK = (
    re.compile(rf"(?:报告人|作者|联系人|提交者|维护者|姓名)[：:][ ]?(?!\w*(?:文档|团队|项目))([{_HAN}]{{2,4}}(?:·[{_HAN}]{{1,6}})?)(?![{_HAN}])"),
    re.compile(rf"感谢([{_HAN}]{{2,4}})(?=提交|的|报告|提供|修复)"),
    re.compile(rf"(?:報告者|担当|連絡担当|氏名|執筆者)[：:][ ]?([{_HAN}]{{1,4}}[ 　]?[{_HAN}ぁ-ゖァ-ヺー]{{1,5}})(?![{_HAN}ぁ-ゖァ-ヺー]|[：:])"),
    re.compile(rf"(?<![{_HAN}ァ-ヺー])([{_HAN}]{{1,4}}[ 　]?[{_HAN}]{{1,4}})(?=さん|氏[はがの、]|様)"),
)


def _announced(labels: str, titles: str, name: str, end: str) -> re.Pattern:
    """Names after a label with a colon, or after a title."""
    return re.compile(rf"(?:(?:{labels})[ ]?[:：][ ]?|(?<![^\W\d_])(?:{titles}))({name}){end}")


_AR, _HI, _TH, _KO = "[\u0621-\u064a\u064b-\u0652]{2,}", "[\u0900-\u0963\u0970-\u097f]{2,}", "[\u0e01-\u0e4e]{2,}", "[가-힣]"
#: Scripts without capitals: only where a label or a title announces the name.
_OTHER = (
    (re.compile("[\u0621-\u064a]"), _announced("الاسم|المؤلف|الكاتب|المبلغ|كتبه|أبلغ عنه|جهة الاتصال", "(?:السيدة?|الدكتورة?)[ ]", rf"{_AR}(?:[ ]{_AR}){{1,2}}", "")),
    (re.compile("[\u0900-\u097f]"), _announced("नाम|लेखक|संपर्क|रिपोर्टकर्ता|प्रेषक", "(?:श्री|श्रीमती|डॉ\\.)[ ]", rf"{_HI}(?:[ ]{_HI}){{1,2}}", "")),
    (re.compile("[\u0e01-\u0e4e]"), _announced("ชื่อ|ผู้เขียน|ผู้รายงาน|ผู้ติดต่อ|ผู้ดูแล", "นางสาว|นาย|นาง|คุณ", rf"{_TH}[ ]{_TH}", "")),
    (re.compile("[가-힣]"), _announced("이름|성명|작성자|담당자|보고자|연락처|저자|제보자", "(?!)", rf"{_KO}{{2,4}}(?:[ ]{_KO}{{1,3}})?", "(?!\\w)")),
    (re.compile("[가-힣]"), re.compile(rf"(?<!\w)({_KO}{{2,4}})(?=[ ]?(?:씨|님)(?:께서|[이가은는을를의께도])?(?!\w))")),
)

#: Letters that Unicode does not decompose.
_LATIN = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ð": "d", "þ": "th"})


class Finder:
    """The spans of one text, with the names learned from a corpus."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in order of start, without overlaps."""
        if not text:
            return []
        found: list[tuple[int, int, int, float]] = []
        for sign in _EMAIL_SIGNS:
            at, done = text.find(sign), 0
            while at >= 0:
                m = next((m for m in _EMAIL.finditer(text, max(done, at - 80), at + 200) if m.end() > at), None)
                if m and m.start() < at:
                    found.append((0, m.start(), m.end(), 1.0))
                    done = m.end()
                at = text.find(sign, max(at + 1, done))
        self._numbers(text, found)
        self._addresses(text, found)
        self._names(text, found)
        taken, out = [], []
        for kind, a, b, score in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1], -x[3])):
            if score >= THRESHOLD and all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                out.append((KINDS[kind], a, b))
        return sorted(out, key=lambda x: x[1])

    def plus(self, more: list | None) -> "Finder":
        """This finder with further (kind, name) entries."""
        if not more:
            return self
        return Finder(Both(self.given, {n for k, n in more if k == "given"}), Both(self.family, {n for k, n in more if k == "family"}))

    def candidates(self, text: str | None) -> set[str]:
        """Every name of `text` that `spans` may look up."""
        out = set()
        for m in _GIVEN_AT.finditer(text or ""):
            back = _BEFORE_GIVEN.search(text[max(0, m.start() - 60) : m.start()])
            after = _AFTER_GIVEN.match(text, m.end())
            if back or after:
                out |= {m.group().partition("-")[0], *(x.group(1) for x in (back, after) if x)}
        for sign in _INITIAL_SIGN.finditer(text or ""):
            if m := _INITIAL_AT.match(text, sign.start()):
                out.add(m.group(2))
        return {self._flat(x) for x in out}

    def _numbers(self, text: str, found: list) -> None:
        for run in _DIGITS.finditer(text):
            low, high = max(0, run.start() - 5), min(len(text), run.end() + 4)
            for m in _ID.finditer(text, low, high):
                before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
                score = _id_score(m.lastgroup if m.lastgroup else "twelve", m.group())
                near = before.rpartition("\n")[2]
                if _ID_CUE.search(near) or re.match(r"[ \"'”»)]{0,3}(?:as|als|como|comme)\b", after) and _ID_CUE.search(after):
                    score += 0.5
                if _OTHER_NUMBER.search(near) or _OTHER_AFTER.match(after):
                    score -= 0.5
                found.append((1, m.start(), m.end(), score))
            for m in _PHONE.finditer(text, low, high):
                near, after = text[max(0, m.start() - 30) : m.start()].rpartition("\n")[2], text[m.end() : m.end() + 10]
                number, wide = m.group(), text[max(0, m.start() - 80) : m.start()]
                weak = m.lastgroup in _WEAK_PHONES
                score = 0.3 if weak else 0.7 if number[0] in "+(" else 0.6
                if _PHONE_CUE.search(near) or weak and (not near or _ROW_CUE.search(near)) and _EMAIL_SIGN.search(wide):
                    score += 0.4
                if _OTHER_NUMBER.search(near) or _OTHER_AFTER.match(after):
                    score -= 0.6
                if not 8 <= sum(c.isdigit() for c in number) <= 15:
                    score -= 0.6
                found.append((2, m.start(), m.end(), score))

    def _addresses(self, text: str, found: list) -> None:
        for k, (pattern, base) in enumerate(_ADDRESSES):
            done = 0
            for a, b in sorted(_address_signs(text, k)):
                if a < done:
                    continue
                m = pattern.search(text, max(done, a - 40), min(len(text), b + 110))
                if not m or m.end() <= a:
                    continue
                done = end = m.end()
                score = base + 0.4 * bool(m.group(1)) + 0.3 * bool(_ADDRESS_CUE.search(text[max(0, m.start() - 40) : m.start()]))
                while text[end - 1] in ".," and not re.search(r"(?:Ave|St|Rd|Blvd|str)\.$", text[max(0, end - 6) : end]):
                    end -= 1
                found.append((3, m.start(), end, score + 0.3 * bool(re.search(r"[|;·\t][ ]?$", text[max(0, m.start() - 3) : m.start()]))))

    def _names(self, text: str, found: list) -> None:
        given, family = self.given, self.family
        unlisted, listed = [], []
        for m in _GIVEN_AT.finditer(text):
            if m.start() and ((c := text[m.start() - 1]) in _JOINED or c.isalnum()):
                continue
            back = text[m.start() - 2 : m.start()] == ", " and _BEFORE_GIVEN.search(text[max(0, m.start() - 60) : m.start()])
            after = _AFTER_GIVEN.match(text, m.end())
            if not back and not after:
                continue
            known = self._flat(m.group().partition("-")[0]) in given
            if back:
                start = m.start() - len(back.group())
                middle = _MIDDLE.match(text, m.end())
                end = middle.end() if middle else m.end()
                score = self._unlisted(text, start, end, m.group(), back.group(1), bool(middle), found)
                if known:
                    near, tail = text[max(0, start - 20) : start], text[end : end + 20]
                    score = max(score, 0.3 + 0.3 * (self._flat(back.group(1)) in family) + 0.3 * bool(_NAME_CUE.search(near) or not near or near[-1] in "\n|;·\t\"") + 0.2 * bool(_NAME_AFTER.match(tail)))
                if score >= THRESHOLD:
                    (listed if known else unlisted).append((4, start, end, score))
                    continue
            if after:
                if known:
                    listed.append((4, m.start(), after.end(), 0.7 + 0.2 * (self._flat(after.group(1)) in family)))
                elif (score := self._unlisted(text, m.start(), after.end(), m.group(), after.group(1), after.start(1) > m.end() + 1, found)) >= THRESHOLD:
                    unlisted.append((4, m.start(), after.end(), score))
        found += listed + [x for x in unlisted if all(x[2] <= a or b <= x[1] for _, a, b, _ in listed)]
        if "." in text:
            for sign in _INITIAL_SIGN.finditer(text):
                m = _INITIAL_AT.match(text, sign.start())
                if not m or m.start() and ((c := text[m.start() - 1]) in _JOINED or c.isalnum()):
                    continue
                near, tail = text[max(0, m.start() - 20) : m.start()], text[m.end() : m.end() + 20]
                known = self._flat(m.group(2)) in family
                said = _NAME_CUE.search(near)
                cue = bool(said) * (1 if said and said.group().lower().strip() in ("as", "was", "that", "by", "from") else 2)
                row = bool(_NAME_AFTER.match(tail)) + bool(re.match(r"[ ]?[|;·\t]", tail)) / 3
                made = bool(re.match(r"(?:Mc|Mac|[A-Z]['’])[A-ZÀ-Þ]|[a-z]", m.group(2)))
                found.append((4, m.start(), m.end(), 0.2 + 0.4 * known + 0.2 * cue + 0.3 * row + 0.4 * made))
        if text.isascii():
            return
        if re.search(r"[А-ЯЁ]", text):
            for m in _CYR.finditer(text):
                words = m.group().split(" ")
                start = m.start()
                if len(words) > 1 and words[0] in _CYR_CUE:
                    start += len(words[0]) + 1
                    words = words[1:]
                if len(words) > 1:
                    found.append((4, start, m.end(), 0.6))
        if re.search(r"[一-鿿]", text):
            for pattern in _CJK:
                for m in pattern.finditer(text):
                    found.append((4, m.start(1), m.end(1), 0.8))
        for sign, pattern in _OTHER:
            if sign.search(text):
                found += [(4, m.start(1), m.end(1), 0.8) for m in pattern.finditer(text)]

    def _unlisted(self, text: str, start: int, end: int, first: str, last: str, middle: bool, found: list) -> float:
        """The score of a given name that no list holds: cues, row and the family name's list and form."""
        if first.lower() in _NO_NAME or last.lower() in _NO_NAME:
            return 0.0
        near, tail = text[max(0, start - 40) : start].rpartition("\n")[2], text[end : end + 20]
        cue = 0.5 if _CLOSING.search(text[max(0, start - 40) : start]) else next((worth for worth, pattern in _CUES if pattern.search(near)), 0.0)
        ended = _ENDS_AFTER.match(tail)
        score = 0.1 + 0.3 * (self._flat(last) in self.family) + cue + (0.5 if _PERSON_AFTER.match(tail) else 0.3 if _SAID_AFTER.match(tail) else 0.1 * bool(ended))
        score += 0.2 * bool(_MADE.match(last)) + 0.2 * bool(middle and cue) + 0.2 * bool(cue == 0.4 and _THANKED_FOR.match(tail))
        if score < THRESHOLD and ended:
            # the field or line after it is an item of the same person, or an address in its line has its parts
            after = end + len(re.match(r"[\s|;·]*", tail).group())
            if any(kind < 4 and sure >= THRESHOLD and end < a <= after <= a + 1 for kind, a, _, sure in found):
                score += 0.4
            elif not near.strip() or _ROW_CUE.search(near):
                score += 0.6 * self._addressed(text, start, end, first, last)
        return score

    @classmethod
    def _addressed(cls, text: str, start: int, end: int, first: str, last: str) -> bool:
        """Whether an e-mail address in the same line has both names, or one and the initial of the other."""
        at, to = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        line = text[max(at, start - 300) : min(end + 300, len(text) if to < 0 else to)]
        a, b = cls._flat(first.partition("-")[0]), cls._flat(last)
        for m in _EMAIL.finditer(line) if _EMAIL_SIGN.search(line) else ():
            local = cls._flat(re.split(_AT, m.group())[0])
            if a in local and b in local or local.startswith((a[0] + b, b + a[0])):
                return True
        return False

    @staticmethod
    def _flat(name: str) -> str:
        name = name.lower()
        if not name.isascii():
            name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).translate(_LATIN)
        return re.sub(r"[\W_]", "", name)


def name_list(docs: DataFrame, text_col: str = "text", min_count: int = 3) -> DataFrame:
    """(kind, name, n): given and family names in the parts of e-mail addresses of all texts, given names in at least `min_count` addresses."""
    parts = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?<![\w.+-])[a-z]{3,20}[._][a-z]{3,30}(?=@|\(at\))"), 0)
    local = docs.where(F.col(text_col).contains("@") | F.col(text_col).contains("(at)")).select(F.explode(parts).alias("local"))
    split = local.select(F.split("local", r"[._]").alias("p"))
    both = F.array(F.struct(F.lit("given").alias("kind"), F.col("p")[0].alias("name")), F.struct(F.lit("family").alias("kind"), F.col("p")[1].alias("name")))
    counts = split.select(F.explode(both).alias("x")).select("x.kind", "x.name").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    both = counts.groupBy("name").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("given", "family")))
    # a word that is a family name far more often is no given name
    kept = F.array(F.struct(F.lit("given").alias("kind"), F.when((F.col("given") >= min_count) & (F.col("given") > F.col("family")), F.col("given")).alias("n")), F.struct(F.lit("family").alias("kind"), F.when(F.col("family") > 0, F.col("family")).alias("n")))
    return both.select("name", F.explode(kept).alias("x")).select("x.kind", "name", "x.n").where("n is not null")


def learn_names(docs: DataFrame, text_col: str = "text", min_count: int = 3) -> tuple[set[str], set[str]]:
    """The whole of `name_list` as two sets."""
    rows = name_list(docs, text_col, min_count).collect()
    return tuple({r["name"] for r in rows if r["kind"] == kind} for kind in ("given", "family"))


def _looked_up(docs: DataFrame, text_col: str, names: tuple[set[str], set[str]] | None, max_names: int) -> tuple[DataFrame, Finder]:
    """`docs` with a last column of the names of each text that the finder lacks, and the finder of the most frequent names."""
    none = F.lit(None).cast("array<struct<kind:string,name:string>>")
    more = free_name(docs, "more_names")
    if names is not None:
        return docs.withColumn(more, none), Finder(*names)
    full = cut(name_list(docs, text_col))
    head = full.orderBy(F.desc("n"), "kind", "name").limit(max_names + 1).collect()
    finder = Finder(*({r["name"] for r in head[:max_names] if r["kind"] == kind} for kind in ("given", "family")))
    if len(head) <= max_names:
        return docs.withColumn(more, none), finder
    last = head[-1]
    rest = full.where((F.col("n") < last["n"]) | (F.col("n") == last["n"]) & ((F.col("kind") > last["kind"]) | (F.col("kind") == last["kind"]) & (F.col("name") >= last["name"])))

    def rule(keys, texts):
        rows = [(key, name) for key, text in zip(keys, texts) for name in finder.candidates(text)]
        return [list(c) for c in zip(*rows)] if rows else [[], []]

    key = free_name(docs, "text_key")
    hashed = docs.withColumn(key, F.xxhash64(text_col))
    held = map_lists(hashed.select(key, text_col), rule, "h bigint, name string").distinct().join(rest, "name")
    held = held.groupBy(F.col("h").alias(key)).agg(F.collect_set(F.struct("kind", "name")).alias(more))
    return hashed.join(held, key, "left").select(*docs.columns, more), finder


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[set[str], set[str]] | None = None, max_names: int = 500_000) -> DataFrame:
    """(id_col, kind, start_pos, end_pos): every item of personal information."""
    flat, finder = _looked_up(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", names, max_names)

    def rule(ids, texts, more):
        rows = [(key, *span) for key, text, m in zip(ids, texts, more) for span in finder.plus(m and [tuple(x.values()) for x in m]).spans(text)]
        return [list(c) for c in zip(*rows)] if rows else [[], [], [], []]

    kind = flat.schema["id"].dataType.simpleString()
    return map_lists(flat, rule, f"id {kind}, kind string, start_pos int, end_pos int").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", names: tuple[set[str], set[str]] | None = None, max_names: int = 500_000) -> DataFrame:
    """`docs` with every item replaced by [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS], and the
    number of them in a further column `n_replaced`."""
    known, finder = _looked_up(docs, text_col, names, max_names)
    at = docs.columns.index(text_col)

    def rule(*columns):
        *columns, more = columns
        counts, texts = [], []
        for text, m in zip(columns[at], more):
            spans = finder.plus(m and [tuple(x.values()) for x in m]).spans(text)
            counts.append(len(spans))
            for kind, a, b in reversed(spans):
                text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
            texts.append(text)
        columns[at] = texts
        return [*columns, counts]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_lists(known, rule, f"{fields}, {free_name(docs, 'n_replaced')} int")
