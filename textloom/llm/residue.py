"""Problem 4: template residue and error-page text."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from http import HTTPStatus

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Bounded, map_rows
from textloom.llm.language import FUNCTION_WORDS

_TOKEN = re.compile(r"[^\W_]+")
#: Share of a passage's weight, and of its words that aren't function words, that an exemplar must cover.
COVERAGE, WORDS_COVERED = 0.7, 0.6


class Exemplar:
    """A labelled kind of message: groups of alternative words, one of each of which it must have, and the
    words that may go with them. It stands for all messages that can be formed so."""

    __slots__ = ("label", "groups", "words")

    def __init__(self, label: str, groups: list[str], others: str, function: frozenset[str]):
        self.label = label
        self.groups = [frozenset(g.split()) for g in groups]
        self.words = frozenset(others.split()).union(*self.groups, function)


#: Function words; to those that tell languages apart come pronouns, auxiliaries and what apostrophes leave.
FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
for _k, _v in {
    "en": "you our don t s d re ve ll does must need needs most while here i please am this that there before again any",
    "de": "hier ihrem ihren ihre ihr bitte um diese dieser dieses muss müssen kann können wurde derzeit",
    "fr": "ici votre vos n d l s doit doivent peut cette veuillez a à actuellement",
    "es": "aquí su sus debe deben puede esta por favor actualmente",
    "it": "qui il suo tua tuo deve devono può questa per favore attualmente è",
    "pt": "aqui seu sua deve devem pode esta por favor atualmente é",
    "nl": "hier uw moet moeten kan deze dit gelieve momenteel alstublieft u",
}.items():
    FUNCTION[_k] = FUNCTION[_k].union(_v.split())

# Words of messages by what they are about, per language: what is asked for or broken, what
# is said of it, and what goes with that. From general knowledge of such messages, not from any table.
_SCRIPT = {
    "en": ("javascript js ecmascript script scripts scripting noscript cookies", "enable enabled enabling activate activated allow allowed turn turned switch switched unblock permit on off required requires require need needs needed must disabled blocked support supported without works running run seems", "reading viewing accessing using proceeding continuing before client side browser browsers settings preferences site website page app application device reader widget viewer content document text reply answer article full complete remaining whole to in your this reload refresh view see read show display shown load continue proceed try use properly correctly work then order back web modern currently sorry but it not doesn cannot can part parts some"),
    "de": ("javascript skripte scripts cookies", "aktivieren aktiviert aktiviere einschalten eingeschaltet erlauben zulassen deaktiviert benötigt erfordert erforderlich ausgeschaltet schalten blockiert unterstützt ein", "browser seite website anwendung inhalt inhalte text anzeigen sehen lesen fortfahren fortzufahren laden neu einstellungen nutzen verwenden korrekt angezeigt ihrem damit sehen"),
    "fr": ("javascript scripts cookies", "activer activez activé activés autoriser autorisez désactivé nécessite nécessaire requis requiert bloqués bloqué prend charge", "navigateur page site contenu texte afficher voir lire continuer recharger recharge paramètres application utiliser fonctionner correctement affichage accéder suite"),
    "es": ("javascript scripts cookies", "activar active activa activado habilitar habilite habilita habilitado permitir permita desactivado deshabilitado requiere necesita necesario bloqueado admite", "navegador página sitio contenido texto ver leer mostrar continuar recargar recargue configuración aplicación usar funcionar correctamente web"),
    "it": ("javascript script cookie", "attivare attiva attivi attivato abilitare abilita abiliti abilitato consentire consenti disattivato disabilitato richiede necessario serve bloccato supporta occorre", "browser pagina sito contenuto testo visualizzare vedere leggere mostrare continuare ricaricare ricarica impostazioni applicazione usare utilizzare funzionare correttamente web proseguire"),
    "pt": ("javascript scripts cookies", "ativar ative ativado habilitar habilite habilitado permitir permita desativado desabilitado requer precisa necessário bloqueado suporta exige", "navegador página site conteúdo texto ver ler mostrar exibir continuar recarregar recarregue configurações aplicativo aplicação usar utilizar funcionar corretamente prosseguir"),
    "nl": ("javascript scripts cookies", "inschakelen ingeschakeld schakel activeren activeer geactiveerd toestaan uitgeschakeld vereist nodig geblokkeerd ondersteunt zet aan in", "browser pagina site website inhoud tekst bekijken zien lezen tonen weergeven doorgaan verder herladen laad opnieuw instellingen applicatie app gebruiken werken goed"),
}
_TECHNICAL = "error errors code status num hexid id message request requests http https html head title body h1 p hr div center type detail details response null exit exception server api json internal unexpected reference trace ray incident correlation timestamp failure failed upstream nginx apache cloudflare exceeded service sorry oops hmm whoops uh oh"
_RETRY = {
    "en": "try trying again later retry wait moment few minutes seconds reload refresh contact administrator support help page home back check url address persists problem continue shortly soon patience inconvenience apologize apologise if sign log in",
    "de": "versuchen versuche erneut später noch einmal laden neu wenden administrator support minuten startseite zurück problem melden anmelden fehler leider entschuldigung",
    "fr": "réessayer réessayez plus tard nouveau ultérieurement recharger contactez contacter administrateur minutes accueil retour problème connecter reconnecter erreur désolé malheureusement instants",
    "es": "intente intentar inténtelo nuevo más tarde vuelva recargar contacte administrador minutos inicio volver problema iniciar sesión error lo sentimos momento",
    "it": "riprovare riprova riprovi più tardi nuovo ricaricare contattare contatti amministratore minuti home tornare problema accedere accedi errore spiacenti siamo momento",
    "pt": "tente tentar novamente mais tarde recarregar contate contacte administrador minutos início voltar problema entrar erro lamentamos desculpe momento",
    "nl": "probeer proberen opnieuw later nogmaals laden herladen neem contact beheerder minuten startpagina terug probleem aanmelden inloggen fout sorry helaas moment",
}
_ERROR = {
    "en": [
        ("page url address document file resource site link article content", "found exist exists moved removed deleted missing unavailable available displayed opened reached located", "not could couldn can cannot t be been was were has have is are requested looking find longer may seem seems permanently temporarily on this server we the you what broken name changed or", "neg"),
        ("found find looking exist", "status looking seem seems page requested url", "not we can t couldn cannot what you are for to oops sorry resource server was", "neg"),
        ("server service backend gateway endpoint worker model site website system host api upstream application database proxy cluster node platform", "unavailable unreachable down overloaded busy crashed refused failed respond responding answer unexpected maintenance offline rejected exhausted timeout unable unhealthy capacity error", "is are was were did not could currently temporarily in time while handling connection connecting to returned an for your this our undergoing scheduled with other processing process out of memory due high load traffic reached be made that one", ""),
        ("request requests connection connect operation query call fetch stream response reply output generation transfer download lookup", "timed timeout refused reset aborted interrupted closed cancelled canceled truncated terminated failed rejected incomplete unresolved", "out by peer was the server has been due an before headers complete took too long limit could not be completed cut upstream connect disconnect remote end after ms s dns network connection host name while waiting for generating", ""),
        ("session login token credentials sign-in", "expired timed invalid ended inactivity longer", "has your out please sign log in again to continue due is no valid have been you were logged", ""),
        ("sign log logged", "continue again session account", "in please to you must need be required access this page content view", ""),
        ("access permission permissions authorized authorised privileges", "denied forbidden required insufficient permission access view resource page document", "you not do don t have are is to this the on server sufficient necessary right rights", "neg"),
        ("rate quota limit limits requests usage credits", "exceeded reached many exhausted limit", "too for this your key account plan current please slow down you have per minute hour day check billing has been too", ""),
        ("wrong error problem failure issue exception", "occurred happened went encountered generating processing loading fetching rendering unexpected internal", "something an has have while your this the request response page with our end we are unknown unhandled during there was been fixing it sorry on data", ""),
        ("try retry reload refresh", "again later retry moment page shortly minutes", "please wait and in a few or this the", "only"),
        ("reference trace request incident ray correlation error event support", "hexid", "id code number no your the is", "only"),
        ("traceback stack exception panic segfault segmentation core", "recent trace dumped fault thread uncaught unhandled goroutine", "most call last in main java lang python at error", ""),
        ("exception", "exception", "", ""),
        ("bad internal not forbidden unauthorized gateway timeout service too conflict gone payment method unprocessable", "status", "request gateway server error found timeout unavailable many requests required allowed large entity payload", ""),
        ("out memory disk space", "memory space left killed allocate allocation", "out of no device cannot process was on ran cuda heap java", ""),
        ("status", "error errors failure failed fault crash upstream fatal", "", ""),
        ("maintenance", "scheduled undergoing down back temporarily planned", "we are is the site system service be for will shortly soon please check currently under", ""),
        ("text message reply answer response output content", "generated generate unavailable loaded blocked filtered removed retrieved produced", "could not be no was were received from the model by unable to failed due content filter safety system empty", "neg"),
    ],
    "de": [
        ("seite adresse dokument datei inhalt url", "gefunden existiert verfügbar verschoben gelöscht vorhanden entfernt angezeigt", "nicht die das angeforderte gesuchte wurde konnte kann werden mehr ist status leider fehler diese aufgerufene", ""),
        ("dienst server anwendung verbindung anfrage website system modell", "verfügbar erreichbar überlastet fehlgeschlagen abgelehnt unterbrochen abgebrochen zeitüberschreitung wartung ausgefallen antwortet interner abgelaufen gestört", "vorübergehend derzeit momentan nicht ist der die wurde wegen wird gewartet zurzeit zum zur", ""),
        ("zugriff berechtigung zugang", "verweigert keine fehlt gesperrt erforderlich", "sie haben auf diese seite diesen inhalt wurde für", ""),
        ("sitzung anmeldung", "abgelaufen beendet ungültig erforderlich", "ihre ist bitte melden sie sich erneut an wieder wegen inaktivität", ""),
        ("fehler problem", "aufgetreten status unerwarteter interner schiefgelaufen schief", "ein ist es leider bei der verarbeitung ihrer anfrage etwas seite serverfehler", ""),
        ("schiefgelaufen schief interner", "etwas serverfehler gelaufen gegangen", "ist da leider", ""),
        ("viele anfragen limit kontingent", "anfragen überschritten erreicht ausgeschöpft", "zu das die ihr rate für diesen schlüssel", ""),
    ],
    "fr": [
        ("page adresse document fichier contenu ressource url", "introuvable existe trouvée trouvé disponible déplacée supprimée demandée", "la le demandée demandé n est pas été a plus cette que vous recherchez cherchez erreur status ou", ""),
        ("service serveur application connexion requête site système modèle", "indisponible disponible surchargé refusée échoué interrompue expiré maintenance injoignable délai interne répond", "est temporairement actuellement le la n a pas été du en cours pour momentanément dépassé", ""),
        ("accès autorisation", "refusé interdit autorisé requise requis", "vous n avez pas êtes à cette page l ce document", ""),
        ("session connexion", "expiré expirée terminée invalide", "votre a est veuillez vous reconnecter pour continuer", ""),
        ("erreur problème", "produite survenue interne inattendue produit status", "une s est serveur du lors traitement de votre demande un", ""),
        ("limite quota requêtes trop", "atteinte dépassé dépassée requêtes", "de votre a été est pour cette clé", ""),
    ],
    "es": [
        ("página dirección documento archivo contenido recurso url", "encontrada encontrado encontró existe disponible movida eliminada solicitada", "no la el se ha sido está que busca buscas error status o ya solicitado", ""),
        ("servicio servidor aplicación conexión solicitud sitio sistema modelo", "disponible sobrecargado rechazada fallido fallado interrumpida agotado mantenimiento inaccesible interno responde caído", "no está temporalmente en el la ha sido actualmente tiempo espera por momento", ""),
        ("acceso permiso permisos autorización", "denegado prohibido restringido necesarios requerido", "no tiene para a esta página este documento ver", ""),
        ("sesión", "caducado expirado finalizado caducada expirada", "su ha la iniciar de nuevo vuelva a por inactividad", ""),
        ("error problema mal", "producido ocurrido interno inesperado salió ocurrió servidor", "se ha un algo del al procesar su solicitud hubo", ""),
        ("límite cuota solicitudes demasiadas", "alcanzado superado excedido solicitudes", "ha el la de se para esta clave", ""),
    ],
    "it": [
        ("pagina indirizzo documento file contenuto risorsa url", "trovata trovato esiste disponibile spostata rimossa trovare richiesta", "non la il è stata stato che cerchi cercate impossibile più errore status o richiesto", ""),
        ("servizio server applicazione connessione richiesta sito sistema modello", "disponibile sovraccarico rifiutata fallita interrotta scaduto scaduta manutenzione irraggiungibile interno risponde", "non è temporaneamente il la in stata al momento attualmente per tempo", ""),
        ("accesso permesso permessi autorizzazione", "negato vietato autorizzato necessari richiesto", "non hai ha i per questa pagina questo documento", ""),
        ("sessione", "scaduta terminata", "la tua sua è accedi di nuovo per continuare", ""),
        ("errore problema storto", "verificato interno imprevisto andato server", "si è un qualcosa del durante l elaborazione della richiesta", ""),
        ("limite quota richieste troppe", "raggiunto superato superata richieste", "hai il la di è stato per questa chiave", ""),
    ],
    "pt": [
        ("página endereço documento arquivo ficheiro conteúdo recurso url", "encontrada encontrado existe disponível movida removida solicitada pedida", "não a o foi está que procura mais erro status ou solicitado", ""),
        ("serviço servidor aplicação aplicativo conexão ligação pedido site sistema modelo", "indisponível disponível sobrecarregado recusada falhou interrompida esgotado manutenção inacessível interno responde expirou", "não está temporariamente em o a foi no momento por tempo", ""),
        ("acesso permissão permissões autorização", "negado proibido restrito necessárias recusado", "não tem para esta página este documento acessar ver", ""),
        ("sessão", "expirou expirada terminou encerrada", "sua a foi inicie entre novamente para continuar", ""),
        ("erro problema errado", "ocorreu interno inesperado deu servidor aconteceu", "um algo do ao processar seu pedido sua solicitação houve", ""),
        ("limite cota quota pedidos solicitações muitos", "atingido excedido excedida pedidos solicitações", "foi o a de para esta chave", ""),
    ],
    "nl": [
        ("pagina adres document bestand inhoud url", "gevonden bestaat beschikbaar verplaatst verwijderd opgevraagde gevraagde", "niet de het is werd kan kon worden die u zoekt meer fout status of", ""),
        ("dienst server applicatie verbinding verzoek site website systeem model service", "beschikbaar bereikbaar overbelast mislukt geweigerd onderbroken verbroken onderhoud interne verlopen reageert", "tijdelijk niet is de het op dit moment werd wegens in momenteel", ""),
        ("toegang rechten toestemming", "geweigerd verboden vereist onvoldoende geen", "u heeft tot deze pagina dit document voor", ""),
        ("sessie", "verlopen beëindigd", "uw is log opnieuw in om door te gaan meld aan", ""),
        ("fout probleem mis", "opgetreden onverwachte interne gegaan ging", "er is een iets bij het verwerken van uw verzoek serverfout", ""),
        ("limiet quota verzoeken", "bereikt overschreden veel", "u heeft te de van is voor deze sleutel", ""),
    ],
}
_FILLER = {
    "en": [
        ("placeholder dummy filler sample blind nonsense boilerplate", "text content copy paragraph paragraphs sentence heading title words layout wording", "this is a an the for only to be replaced replace before publishing publication goes here insert add your use used just some final real will follow come later design mockup template until ready"),
        ("text content copy title heading caption description paragraph body headline abstract bio summary", "goes here insert add supplied enter placeholder replace replaced forthcoming coming", "your to be come soon the this a follow go with own in write type please this later tbd tk real final some"),
        ("copy content text", "come follow soon tk tba", "to more be goes is will coming here body"),
        ("test testing", "test testing num", "this is a just only one two three"),
        ("quick", "fox", "the brown jumps over lazy dog"),
        ("foo blah", "bar blah baz", "qux"),
    ],
    "de": [("platzhalter platzhaltertext blindtext beispieltext mustertext fülltext", "platzhalter platzhaltertext blindtext beispieltext mustertext fülltext", "bitte ersetzen hier steht der text später dies ist ein nur einfügen durch echten vor veröffentlichung folgt noch nicht"), ("hier", "text", "steht der ihr einfügen kommt folgt ihren bitte noch")],
    "fr": [("provisoire remplissage factice exemple substitution", "texte contenu paragraphe", "à remplacer de ceci est un faux avant publication ici votre insérer le"), ("texte", "ici insérer remplacer", "votre le à insérez écrire saisissez")],
    "es": [("ejemplo relleno provisional prueba marcador", "texto contenido párrafo", "de sustituir reemplazar después este es un aquí su antes publicar posición para"), ("texto", "aquí insertar inserte", "su el va escriba introduzca")],
    "it": [("segnaposto esempio provvisorio riempitivo prova", "testo contenuto paragrafo", "di da sostituire questo è un qui prima della pubblicazione"), ("testo", "qui inserire inserisci", "il va tuo suo")],
    "pt": [("exemplo preenchimento provisório teste marcador", "texto conteúdo parágrafo", "de substituir depois este é um aqui antes publicar a da publicação"), ("texto", "aqui insira inserir", "o seu vai coloque")],
    "nl": [("voorbeeldtekst plaatshouder plaatshoudertekst tijdelijke opvultekst vultekst dummytekst", "voorbeeldtekst plaatshoudertekst plaatshouder opvultekst vultekst dummytekst tekst", "vervangen nog te dit is een hier vóór publicatie later door"), ("tekst", "hier invoegen invoeren", "komt de uw voer")],
}
# The Latin that layouts are filled with, and the words that generators of it add.
_LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation
ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
officia deserunt mollit anim id est laborum perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi
architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi
tempora incidunt magnam aliquam quaerat minima nostrum exercitationem corporis suscipit laboriosam aliquid commodi autem vel eum iure quam nihil molestiae illum quo at vero accusamus iusto odio
dignissimos ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi occaecati cupiditate provident similique mollitia animi harum quidem rerum facilis expedita
distinctio nam libero tempore cum soluta nobis eligendi optio cumque impedit minus quod maxime placeat facere possimus assumenda repellendus temporibus quibusdam officiis debitis necessitatibus saepe
eveniet voluptates repudiandae recusandae itaque earum hic tenetur a sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat
vestibulum curabitur pellentesque maecenas phasellus vivamus praesent fusce quisque integer nullam suspendisse sodales tincidunt faucibus ornare sollicitudin interdum posuere cursus mauris felis
turpis massa lacus ligula viverra hendrerit feugiat pharetra convallis scelerisque lacinia congue eget nunc orci proin aenean donec morbi nec ac tellus lectus justo ante diam erat urna augue mattis
volutpat venenatis bibendum rhoncus egestas fringilla malesuada fames habitant tristique senectus netus dapibus rutrum luctus ultrices cubilia efficitur sagittis imperdiet condimentum vulputate porta"""
# Only these tell Latin filler from a sentence in Latin or in a language that took its words.
_LATIN_SIGNS = "lorem ipsum consectetur adipiscing eiusmod incididunt exercitation ullamco aliquip reprehenderit cillum excepteur cupidatat deserunt mollit laborum nostrud veniam commodo tempor aliqua voluptate irure consequat perspiciatis voluptatem accusantium doloremque quisquam vestibulum curabitur pellentesque maecenas phasellus vivamus suspendisse tincidunt malesuada tristique scelerisque"


def build_exemplars() -> list[tuple[Exemplar, str]]:
    """All exemplars, each with how it may be used: ``neg`` needs a negation, ``only`` a text without other
    content, ``phrase`` few words, ``few``, ``latin`` and ``keys`` several of its words."""
    out = []
    for k, (what, said, others) in _SCRIPT.items():
        out.append((Exemplar("script", [what, said], others, FUNCTION[k]), ""))
    out.append((Exemplar("script", ["checking verifying verify", "browser human connection"], "before continuing accessing your the is are you secure a just moment please wait this may take few seconds security of site proceed", FUNCTION["en"]), ""))
    for k, kinds in _ERROR.items():
        for what, said, others, use in kinds:
            out.append((Exemplar("error", [what, said], f"{others} {_TECHNICAL} {_RETRY[k]}", FUNCTION[k]), use))
    phrases = " ".join({w for s in HTTPStatus if s >= 400 for w in _TOKEN.findall(s.phrase.lower())})
    out.append((Exemplar("error", ["status", phrases], _TECHNICAL, frozenset()), "phrase"))
    for k, kinds in _FILLER.items():
        for what, said, others in kinds:
            out.append((Exemplar("filler", [what, said], others, FUNCTION[k]), "few" if said.startswith("test") else ""))
    out.append((Exemplar("filler", [_LATIN_SIGNS], _LATIN, frozenset()), "latin"))
    out.append((Exemplar("filler", ["keyrow"], "num", frozenset()), "keys"))
    out.append((Exemplar("placeholder", ["slot"], "", frozenset()), ""))
    return out


# What marks an unfilled placeholder.
_FIELD = r"name|first name|last name|full name|date|time|title|company|address|city|country|email|phone|number|recipient|sender|signature|topic|subject|product|details|nombre|fecha|nom|datum|nome|data|naam"
_SLOT = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\{%[^%\n]{1,80}%\}|\{#[^#\n]{1,80}#\}|#\{[^{}\n]{1,80}\}|\$\{[^{}\n]{1,80}\}|<%=?[^%\n]{1,80}%>|<<\s*[A-Za-z][\w -]{0,60}>>|%%\s*\w[\w -]{0,60}%%|@@\s*\w[\w -]{0,60}@@|##\w[\w -]{0,60}##|\b__[A-Z][A-Z0-9_]*__|(?<![\w$%\\{])\{[A-Za-z_]\w*\}(?!\})|%\(\w+\)s"
    r"|\[(?i:(?:please )?(?:insert|add|enter|fill in|fill|put|type|write|replace|choose|select|your|the|einfügen|hier|insérer|votre|insertar|su|inserire|inserir|invoegen|uw)\b[^\]\n]{0,80}|(?:[\w ]{0,30} )?(?:" + _FIELD + r")(?: here)?|todo|tbd|tba|placeholder|blank)\]"
    r"|\((?i:[\w ]{1,40} (?:goes|go|comes|come) here|(?:insert|add|enter|fill in|your) [\w ]{1,40} here)\)"
    r"|<(?i:(?:your |insert |enter |the )?[a-z]+ (?:" + _FIELD + r"))>|<(?i:insert|enter|your)[^<>\n]{0,60}>"
    r"|\b(?:X{4,}|x{4,}|TKTK)\b|\bTODO: ?\w|\b(?:TBD|TBA|FIXME)\b:?|(?<![_\w])_{4,}(?![_\w])"
)
#: Words of a passage that speaks of placeholders instead of having one left.
_ABOUT = re.compile(r"(?i)\b(templates?|placeholders?|syntax|interpolat\w+|braces|brackets|markup|variables?|vorlage\w*|platzhalter\w*|gabarit|plantilla|marcador|segnaposto|sjabloon)\b")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|return|const|let|var|function|for|if|import|from|else|while|try|print)\b|=>|\)\s*:\s*$|\w\(.*\)\s*$|^\s*[\w.]+\s*[+\-*/]?=\s")
_COMMENT = re.compile(r"(?:#|//|/\*|--)\s*$")
_LITERAL = re.compile(r"`[^`]*`|\"[^\"\n]*\"|'[^'\n]*'")
_HEX = re.compile(r"(?=[0-9a-f]*\d)[0-9a-f]{6,40}$")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[\r\n]+")


_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def is_key_row(w: str) -> bool:
    """Whether a word is a walk along a row of the keyboard."""
    return len(w) > (2 if not set(w) & set("aeiou") else 3) and any(w in row or w[::-1] in row for row in _KEYS)


def term(w: str) -> str:
    """The term of a word in lower case: numbers, status numbers, identifiers, walks along the keyboard
    and names of exceptions stand for themselves."""
    if w[0].isdigit() or w[-1].isdigit():
        if w.isdigit() and len(w) < 6:
            return "status" if len(w) == 3 and w[0] in "45" else "num"
        return "hexid" if _HEX.match(w) else w
    if len(w) > 5 and _HEX.match(w):
        return "hexid"
    if len(w) > 7 and w.endswith(("error", "exception")):
        return "exception"
    return "keyrow" if w.isascii() and is_key_row(w) else w


_known: Bounded = Bounded(200_000)


def terms(passage: str) -> list[str]:
    """The terms of a passage's words."""
    get, put = _known.get, _known.put
    return [get(w) or put(w, term(w)) for w in _TOKEN.findall(passage.lower())]


EXEMPLARS = build_exemplars()
CLASSES = frozenset({"num", "status", "hexid", "keyrow", "exception", "slot"})
#: Inverted index: term to the exemplars and groups that ask for it.
INDEX: dict[str, list[tuple[int, int]]] = {}
for _i, (_e, _) in enumerate(EXEMPLARS):
    for _n, _g in enumerate(_e.groups):
        for _w in _g:
            INDEX.setdefault(_w, []).append((_i, _n))
#: Each exemplar asks for one of these.
_FIRST = frozenset().union(*(e.groups[0] for e, _ in EXEMPLARS))
#: Terms whose frequencies are counted: all that exemplars have.
VOCABULARY = frozenset().union(*(e.words for e, _ in EXEMPLARS)) - CLASSES
_NEGATION = frozenset("not no cannot can't couldn t never longer denied forbidden unavailable missing moved removed deleted failed unable blocked".split())
_ALL_FUNCTION = frozenset().union(*FUNCTION.values())

#: Marks and words that stand for no answer.
STAND_INS = frozenset(
    "null none nil na n/a nan undefined empty blank tbd void missing - -- --- — – . .. ... … ? * _ / x".split()
    + ["no answer", "no response", "no reply", "no output", "no text", "no content", "not available", "not applicable", "not answered", "left blank", "empty response", "no comment", "keine antwort", "ohne antwort", "k.a", "leer", "entfällt", "pas de réponse", "sans réponse", "aucune réponse", "vide", "sin respuesta", "ninguna respuesta", "vacío", "nessuna risposta", "senza risposta", "vuoto", "sem resposta", "nenhuma resposta", "vazio", "geen antwoord", "leeg"]
)
_EDGE = " \t\r\n\f\v\u00a0\u200b\u200c\u200d\u2060\ufeff\u3000()[]{}<>\"'`“”«»*_.!"


_MOST_STAND_IN = max(map(len, STAND_INS))


def is_stand_in(text: str | None) -> bool:
    """Whether a text is null, blank or only stands for the lack of an answer."""
    if not text or text.isspace():
        return True
    bare = text.strip(_EDGE).lower()
    if not any(c.isalnum() for c in bare):
        return True
    return len(bare) < 2 * _MOST_STAND_IN and " ".join(bare.split()) in STAND_INS or bare in STAND_INS


def passages(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if a < b]


_DIGIT = re.compile(r"\d")
#: A placeholder starts where this matches.
_MAY_BE_SLOT = re.compile(r"\{[{%#]|#\{|\$\{|[{\[]\w|<[%<A-Za-z]|%[%(]|@@|##|__|XXXX|xxxx|TKTK|TODO|TB[DA]\b|FIXME|\([^()\n]{1,60} here\)")
_STATUS = re.compile(r"(?<![^\W_])[45]\d\d(?![^\W_])")
_SLOT_MARK = re.compile(r"[{\[<%@]|##|__|XXXX|xxxx|TKTK|TODO|TB[DA]\b|FIXME")


def holding(spans: list[tuple[int, int]], places: list[int]) -> list[tuple[int, int]]:
    """The spans that hold a place, in order."""
    starts = [a for a, _ in spans]
    return [spans[k] for k in sorted({bisect_right(starts, i) - 1 for i in places})]


def known_terms(low: str) -> set[str]:
    """Words of a text in lower case that exemplars have; classes of numbers are left out."""
    words = set(low.split())
    rest = " ".join([w for w in words if not w.isalnum()])
    return (words & VOCABULARY).union(VOCABULARY.intersection(_TOKEN.findall(rest)))


class Detector:
    """Scores passages against the exemplars, with the weights that the corpus gives its terms."""

    def __init__(self, idf: dict[str, float], unknown: float, coverage: float = COVERAGE):
        self.unknown, self.coverage = unknown, coverage
        # A term that all records have weighs next to nothing, but a passage of such terms can be covered.
        self.weight = {t: max(idf.get(t, unknown), 1e-9) for t in {*VOCABULARY, *CLASSES}}

    def best(self, ts: list[str], alone: bool = True) -> tuple[str | None, float]:
        """Class of the exemplar that covers most of the terms' weight, and the share it covers. ``alone``:
        the passage is all there is."""
        words = dict.fromkeys(ts)
        asked: dict[int, int] = {}
        for t in words:
            for i, group in INDEX.get(t, ()):
                asked[i] = asked.get(i, 0) | 1 << group
        found, most = None, 0.0
        total = None
        for i, groups in asked.items():
            e, use = EXEMPLARS[i]
            if groups != (1 << len(e.groups)) - 1 or len(e.groups) > 1 and not self.apart(words, e):
                continue
            if use == "neg" and _NEGATION.isdisjoint(words) and "status" not in words:
                continue
            if use == "only" and not alone:
                continue
            if use == "latin" and len(words.keys() & e.words) < 3 and not {"lorem", "ipsum"} <= words.keys() or use in ("keys", "few") and sum(t in e.words for t in ts) < 3:
                continue
            if total is None:
                weight = {t: self.weight.get(t, self.unknown) for t in words}
                total = sum(weight.values())
                told = [t for t in words if t not in _ALL_FUNCTION]
            share = sum(w for t, w in weight.items() if t in e.words) / total
            fit = sum(t in e.words for t in told)
            if use == "phrase" and len(told) > 6:
                continue
            if told and fit < WORDS_COVERED * len(told):
                continue
            if share > most:
                found, most = e.label, share
        return found, most

    @staticmethod
    def apart(words, e: Exemplar) -> bool:
        """Whether the exemplar's groups are met by different words."""
        a, b = (e.groups[0].intersection(words), e.groups[1].intersection(words))
        return len(a | b) > 1 or e.groups[0] == e.groups[1] or "exception" in a

    def slot(self, passage: str, code: bool) -> bool:
        """Whether the passage has an unfilled placeholder and doesn't speak of one."""
        bare = _SLOT.sub(" ", passage)
        if code or _CODE_LINE.search(bare):
            passage = "\n".join(line for line in _LITERAL.sub(" ", passage).split("\n") if not _CODE_LINE.search(_SLOT.sub(" ", line)))
            m = _SLOT.search(passage)
            if not m or m[0].startswith("TODO") and _COMMENT.search(passage[: m.start()]):
                return False
        return not _ABOUT.search(bare) and self.best(["slot"])[0] is not None

    def kind(self, text: str | None, code: bool = False) -> str | None:
        """``placeholder``, ``filler``, ``error`` or ``script`` if the text has residue, else None."""
        if not text or is_stand_in(text):
            return None
        spans = None
        slots = _SLOT_MARK.search(text) or " here)" in text
        slots = slots and [m.start() for m in _MAY_BE_SLOT.finditer(text) if _SLOT.match(text, m.start())]
        if slots:
            spans = passages(text)
            for a, b in holding(spans, slots):
                if self.slot(text[a:b], code):
                    return "placeholder"
        low = text.lower()
        if _FIRST.isdisjoint(terms(low)):
            return None
        spans = spans or passages(text)
        for a, b in spans:
            p = text[a:b]
            ts = terms(p)
            if _FIRST.isdisjoint(ts) or code and len(spans) > 1 and _CODE_LINE.search(p.rstrip("\n")):
                continue
            c, s = self.best(ts, len(spans) == 1)
            if c and s >= self.coverage and (len(ts) > 1 or len(spans) == 1):
                return c
        return None


def term_weights(records: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the exemplars' terms from their frequencies in all records, and the weight of a
    term that no exemplar has: the median. The driver gets one row per term of the exemplars."""

    def make():
        def work(texts):
            df: Counter = Counter()
            for t in texts:
                df.update(known_terms(t.lower()))
                df["num"] += _DIGIT.search(t) is not None
            return ["", *df], [len(texts), *df.values()]

        return work

    got = map_rows(records.where("text is not null"), ["text"], make, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in got}
    n = df.pop("", 0)
    return weights(df, n)


def weights(df: dict[str, int], n: int) -> tuple[dict[str, float], float]:
    """Weights by the frequencies ``df`` among ``n`` texts. A status number weighs as any number, an
    identifier as an unknown term."""
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) for t in VOCABULARY}
    unknown = sorted(idf.values())[len(idf) // 2] or 1.0
    number = math.log((n + 1) / (df.get("num", 0) + 1))
    return {**idf, "num": number, "status": number, "hexid": unknown, "keyrow": unknown, "exception": unknown, "slot": unknown}, unknown


def find_residue(records: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``(record_id, residue)`` of each record whose text is or holds an unfilled placeholder,
    ``filler``, an ``error`` message or a notice that ``script``s are needed.

    Each passage (sentence or line) brings up, through an inverted index, the exemplars all of whose
    groups it has a word of; it is residue if one of them covers at least ``coverage`` of its TF-IDF
    weight. An unfilled placeholder is a term of the index, too, read by its marks, except in code
    proper, in literals of code and in passages that speak of templates. Texts go through whole;
    null, blank and stand-in texts have no residue; a record delivered twice counts once.
    """
    r = records.where("record_id is not null and text is not null")
    idf, unknown = term_weights(r)

    def make():
        d = Detector(idf, unknown, coverage)

        def work(ids, texts, kinds):
            found = [(i, k) for i, t, c in zip(ids, texts, kinds) if (k := d.kind(t, c == "code"))]
            return [i for i, _ in found], [k for _, k in found]

        return work

    return map_rows(r, ["record_id", "text", "kind"], make, "record_id bigint, residue string").dropDuplicates(["record_id"])


def batch_report(records: DataFrame, hygiene: DataFrame) -> DataFrame:
    """By batch: records, those with residue by class, and the earlier count of artifacts."""
    b = records.select("record_id", "batch_id").dropDuplicates(["record_id"]).join(find_residue(records), "record_id", "left")
    counts = [F.count(F.when(F.col("residue") == k, 1)).alias(k) for k in ("placeholder", "filler", "error", "script")]
    n = b.groupBy("batch_id").agg(F.count("*").alias("records"), F.count("residue").alias("with_residue"), *counts)
    return n.join(hygiene.select("batch_id", "rows_raw", "dropped_error_artifacts"), "batch_id", "full")
