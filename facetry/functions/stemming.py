"""Stop words and stemmers of language analyzers.

English has the Porter algorithm.  Other languages share one rule, by their own tables: after the normalisation of
letters, in each step the longest ending listed goes, if it lies behind the first consonant that follows a vowel and
at least three letters stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

# Short stop word lists.
STOP = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with",
    "fr": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht oder sich sie sind so um und uns von war was wie wir zu zum zur",
    "es": "al como con de del el ella en entre es esta este la las lo los más me mi no nos o para pero por que se sin su sus te un una y ya",
    "it": "al che con da dei del della di e gli ha i il in io la le lo ma mi nel non o per più se si sono su un una",
    "pt": "a ao as com da das de do dos e em é mais na não no nos o os ou para por que se sem sua um uma",
    "nl": "aan als bij dat de den der des die dit door een en er had heb het hij ik in is je maar met naar niet of om op te tot uit van voor was wat zijn",
    "sv": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan sina här ha mot alla under någon eller",
    "no": "og i jeg det at en et den til er som på de med han av ikke der så var meg seg men ett har om vi min mitt ha hadde hun nå over da ved fra du ut sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blitt kunne inn når være kom noen noe",
    "da": "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville",
    "fi": "olla olen on ovat oli minä sinä hän me te he tämä tuo se nämä nuo ne kuka mikä joka että ja jos koska kuin mutta niin sekä sillä tai vaan vai vaikka kanssa mukaan noin yli kun nyt itse ei en",
    "hu": "a az és hogy nem is egy ez ezt azt de ha mint csak már meg vagy volt van lesz volna kell el le fel ki be én te ő mi ti ők",
    "ro": "a al ale am ar are au ca care ce cu de din el ea este eu fi fost în în la mai nu o pe pentru s sau se si și sunt un una unei va",
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему",
    "uk": "і в у не що він на я з як а то все вона так його але та ти до ж ви за б по тільки її мені було від мене ще ні про із йому",
    "bg": "а в и на да не се от за с е като по до са че но те той тя ние вие си би ще",
    "pl": "a aby ale bo by być co czy dla do go i ich jak jest już lub ma na nie o od po się są ta tak to w z za że",
    "cs": "a aby ale ani co do i jak je jeho jen již k ke který na nebo o od po pro s se si tak ten to u v ve z za že",
    "tr": "acaba ama aslında az bazı belki biri birkaç bu çok çünkü da daha de defa diye en gibi hem hep hiç için ile ise kez ki kim mı mu mü nasıl ne neden o sanki şey siz şu tüm ve veya ya yani",
    "ca": "a al amb com de del el els en és i la les no o per perquè què que se si un una",
    "gl": "a ao as con da de do e en é o os ou para por que se un unha",
    "eu": "al anitz arabera bat baina bere da dago den dira du dute edo egin ere eta hau hori zen zuen",
    "ga": "a ach ag agus an ar as ba de do faoi go i is le na ní nó ó sa sé sí thar",
    "id": "ada adalah akan atau dalam dan dari dengan di ini itu juga ke kami kita oleh pada saya sebagai tidak untuk yang",
    "el": "ο η το οι τα του της των τον την και κι μα αν ή να θα με σε από για ως στο στη που δεν",
    "lt": "ir yra į kad su iš o tai kaip bet už ar apie per prie",
    "lv": "un ir uz ka ar no par bet kā vai pie pēc lai kas",
    "et": "ja on ei et see ta ma kui ka aga või oma mis kes seda",
}
# Endings by step.
ENDINGS = {
    "fr": ("issements issement ements ement ations ation atrices atrice ateurs ateur logies logie euses euse ances ance ences ence ités ité ives ive ifs if aient ais ait ant ent ées ée és er ez eux aux ions ons", "es e s"),
    "de": ("ungen ung heiten heit keiten keit lichen liche lich ischen ische isch igen ige ig", "ern em er en es e st s", "end ung"),
    "es": ("amientos imientos amiento imiento aciones ación adores adoras adora ador ancias ancia logías logía encias encia mente idades idad ivas ivos iva ivo", "ábamos aríamos iéramos aremos iremos aban aron ando iendo ados adas idos idas aste iste ando ado ada ido ida ará irá aba ías ían ar er ir", "os as es a o e"),
    "it": ("amento amenti imento imenti azioni azione atore atori logia logie mente ità ivi ivo iva ive", "avano evano ando endo ato ata ati ate uto uta are ere ire", "i e a o"),
    "pt": ("amentos amento imentos imento ações ação adores adoras adora ador logias logia ências ência mente idades idade ivos ivas ivo iva", "aríamos ávamos ando endo indo ados adas idos idas ado ada ido ida ava iam ar er ir", "os as es a o e"),
    "nl": ("heden heid ingen ing lijke lijk baar", "en e s t", "ig"),
    "sv": ("heterna hetens heter heten arnas ernas ornas andes arens andet arna erna orna ande arne aste anden heten erns aren ades ade are ast ens ar er or en at a e s",),
    "no": ("hetenes hetene hetens heter heten endes andes enes ande ende edes erte ede ane ene ers ets het ast ert ens er en ar as et es a e s",),
    "da": ("erendes erende hedens erenes ethed erede hedens heden heder endes ernes erens erets ered ende erne eren erer heds enes eres eret hed ene ere ens ers ets en er es et e s",),
    "fi": ("kaan kään kin han hän ko kö pa pä", "issa issä ista istä illa illä ilta iltä ille ssa ssä sta stä lla llä lta ltä lle iksi ksi ina inä iden ien ita itä tta ttä ta tä na nä ni nsa nsä", "jen jat t i n a ä"),
    "hu": ("okat eket ban ben ból ből nak nek val vel hoz hez höz ról ről tól től ért kor kig ig", "aink eink juk jük unk ünk ok ek ök ak am em om a e t k"),
    "ro": ("urilor ului elor ilor iile uri ului ea ii le ul", "ează ând ate ați are ere ire at it", "e a i ă"),
    "ru": ("ившись ывшись вшись ивши ывши вши", "иями ями ами иях ях ах ием ией ем ом ов ев ей ий ый ой ая яя ое ее ые ие ого его ому ему ыми ими ую юю ет ют ит ят ла на ли ем но ть ешь ут ал ил", "а е и о у ы ь ю я"),
    "uk": ("ями ами ові еві ях ах ів їв ем ом ою ею ий ій ої ая ого ому ими ими их ую ють ать ити ати", "а е и і о у ь ю я"),
    "bg": ("ията ето ите ият ата ове ът та то те", "ия ие а е и о я"),
    "pl": ("owania owanie ościach ościami ości ość", "ami ach owie ego emu ymi imi ych ich ów om ą ę y i a e o u"),
    "cs": ("ostech ostem osti ost", "ových ového ovými ami ách ech ích ého ými ých ům ům em ům ou y i a e o u"),
    "tr": ("larımız lerimiz larınız leriniz ları leri lar ler", "ından inden undan ünden dan den tan ten ında inde da de ta te nın nin nun nün yı yi ı i u ü"),
    "ca": ("aments ament acions ació adors ador itats itat", "ant ent at ada ar er ir", "os es a e o s"),
    "gl": ("amentos amento acións ación idades idade mente", "ando endo ado ada ar er ir", "os as es a o e"),
    "eu": ("arekin aren etako etan etara ekin en ak ek an ra", "a"),
    "ga": ("acha anna íocht acht í a e",),
    "id": ("kan nya lah kah an i",),
    "el": ("ματων ματα ματος", "ους ων ες ας ης ος οι εις ει ου ω α η ο ι ε"),
    "lt": ("uose iuose ose yse ams iams ais iais omis ų ių", "as is us ys es os ė a e i o u"),
    "lv": ("iem ajiem ajām ām ās os iem ais", "as es is us am ā a e i s u"),
    "et": ("dele tele dest test des tes ga", "de te d s i e a u"),
}
_FOLD = {"de": str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}), "fa": str.maketrans({"ي": "ی", "ك": "ک"}), "ckb": str.maketrans({"ي": "ی", "ك": "ک"})}
_VOWELS = frozenset("aeiouyáàâäãåæéèêëíìîïóòôöõøúùûüýąęěůőűăâîıаеёиоуыэюяіїєαεηιουωάέήίόύώ")


@cache
def stop_words(code: str) -> frozenset[str]:
    return frozenset(STOP.get(code, "").split())


@cache
def _steps(code: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(sorted({normal(e, code) for e in step.split()}, key=lambda e: (-len(e), e))) for step in ENDINGS.get(code, ()))


def normal(word: str, code: str) -> str:
    """Letters that a language writes in several ways, in one."""
    if code == "el":
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        return word.replace("ς", "σ")
    if code == "ar":
        word = re.sub("[ً-ْـ]", "", word)
        word = re.sub("[أإآ]", "ا", word).replace("ى", "ي").replace("ة", "ه")
        return word[2:] if word.startswith("ال") and len(word) > 4 else word
    table = _FOLD.get(code)
    return word.translate(table) if table else word


def _behind(word: str) -> int:
    """Where the part begins that endings may be taken from: behind the first consonant that follows a vowel."""
    for k in range(1, len(word)):
        if word[k - 1] in _VOWELS and word[k] not in _VOWELS:
            return k + 1
    return len(word)


def stem(word: str, code: str) -> str:
    if code == "en":
        return porter(word.removesuffix("'s").removesuffix("’s"))
    word = normal(word, code)
    for step in _steps(code):
        behind = max(3, _behind(word) - 1)
        for ending in step:
            if word.endswith(ending) and len(word) - len(ending) >= behind:
                word = word[: -len(ending)]
                break
    return word


# ---- Porter ----


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel behind a consonant."""
    out = ""
    for k, x in enumerate(word):
        vowel = x in "aeiou" or (x == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem_: str) -> int:
    return len(re.findall("v+c", _shape(stem_)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# Fixed values of the algorithm.
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split()


def _replaced(word: str, table: dict[str, str]) -> str:
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            head = word[: -len(ending)]
            return head + table[ending] if _measure(head) > 0 else word
    return word


def porter(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            head = word[: -len(ending)]
            if word.endswith(ending):
                if "v" in _shape(head):
                    if head.endswith(("at", "bl", "iz")):
                        word = head + "e"
                    elif _double(head) and head[-1] not in "lsz":
                        word = head[:-1]
                    else:
                        word = head + "e" if _measure(head) == 1 and _short(head) else head
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2), _STEP3)
    for ending in _STEP4:
        if word.endswith(ending):
            head = word[: -len(ending)]
            if _measure(head) > 1 and (ending != "ion" or head.endswith(("s", "t"))):
                word = head
            break
    if word.endswith("e"):
        head = word[:-1]
        if _measure(head) > 1 or (_measure(head) == 1 and not _short(head)):
            word = head
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
