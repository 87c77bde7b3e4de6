"""Residue and clean sentences that no exemplar was written for."""

import pytest

from textloom.llm import residue

RESIDUE = {
    "script": [
        "JavaScript seems to be disabled; switch it on to proceed.", "It looks like JavaScript is turned off in your web browser.", "This application requires JavaScript to be enabled.", "Sorry, you need JavaScript to use this website properly.", "To view this content you have to allow scripts.", "Scripts are blocked. Unblock them to load the page.", "We're sorry but this app doesn't work properly without JavaScript enabled.",
        "Diese Anwendung erfordert JavaScript.", "JavaScript ist in Ihrem Browser deaktiviert.", "Um die Website korrekt zu nutzen, muss JavaScript aktiviert sein.", "Le JavaScript est désactivé dans votre navigateur.", "Ce site nécessite JavaScript pour fonctionner correctement.", "Habilite JavaScript para continuar.", "Para ver esta página es necesario activar JavaScript.",
        "Per continuare, abilitare JavaScript.", "Questo sito richiede JavaScript per funzionare.", "Para continuar, habilite o JavaScript.", "Este site precisa de JavaScript para funcionar.", "Deze website vereist JavaScript.", "JavaScript is uitgeschakeld in uw browser.",
    ],
    "error": [
        "Backend fetch failed. Guru Meditation.", "502 Bad Gateway nginx", "Error 404: this page does not exist.", "Whoops, something went wrong on our end.", "HTTP 503 - Service Temporarily Unavailable", "The requested resource could not be located on this server.", "Internal Server Error. Please contact the site administrator.", "Your login session timed out due to inactivity.", "Connection reset by peer", "upstream request timeout",
        "You have reached your usage limit. Please try again in 24 hours.", "Access forbidden: you don't have permission to view this page.", "The model is currently unavailable, please retry later.", "An unexpected error occurred while loading the page.", "The site is down for scheduled maintenance.", "RuntimeError: CUDA out of memory.", "java.lang.NullPointerException", "Segmentation fault (core dumped)",
        "Die angeforderte Seite existiert nicht.", "Interner Serverfehler. Bitte versuchen Sie es später erneut.", "Zugriff verweigert: fehlende Berechtigung.", "Der Server ist derzeit nicht erreichbar.", "La page que vous cherchez est introuvable.", "Une erreur inattendue s'est produite.", "Le serveur est momentanément indisponible.", "Votre connexion a expiré, veuillez vous reconnecter.",
        "La página que busca no existe.", "Se ha producido un error interno del servidor.", "El servidor no está disponible en este momento.", "Su sesión ha expirado. Vuelva a iniciar sesión.", "La pagina che cerchi non esiste.", "Si è verificato un errore imprevisto.", "Il servizio non è al momento disponibile.", "Sessione scaduta: accedi di nuovo.",
        "A página que procura não existe.", "Ocorreu um erro interno no servidor.", "O serviço está temporariamente indisponível.", "Sua sessão expirou.", "De opgevraagde pagina bestaat niet.", "Er is een interne fout opgetreden.", "De server is tijdelijk niet bereikbaar.", "Uw sessie is verlopen, log opnieuw in.",
    ],
    "filler": [
        "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.", "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.", "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.", "Placeholder text, to be replaced before publication.", "Dummy content for layout only.", "Your headline goes here", "This is just filler text until the real copy is ready.", "qwertyuiop asdfghjkl zxcvbnm", "sdfg hjkl dfgh fghj sdfgh",
        "Dies ist ein Blindtext.", "Hier kommt Ihr Text.", "Ceci est un texte factice.", "Insérez votre texte ici.", "Este es un texto de relleno.", "Texto de prueba, reemplazar.", "Questo è un testo segnaposto.", "Testo di prova da sostituire.", "Este é um texto provisório.", "Insira seu texto aqui.", "Dit is een plaatshoudertekst.", "Hier komt de tekst nog.",
    ],
    "placeholder": ["Dear [Customer Name], thank you for writing.", "Hello {{first_name}}!", "Sincerely, [Your Name]", "The total is ${amount}.", "Sehr geehrte Frau {{ nachname }}, wir danken Ihnen.", "Bonjour <%= prenom %>, merci.", "Hola %(nombre)s, gracias por escribir."],
}
CLEAN = [
    "The page in the old ledger was missing, and nobody could say who had torn it out.", "Our server at the restaurant was busy, so we waited by the window until noon.", "She enabled the alarm before leaving the house that night.", "The script of the play requires two actors who can sing.", "He wrote a script that moves the files every night.", "In this article we explain how JavaScript engines compile functions before running them.", "Many websites use JavaScript to draw charts from the data that readers enter.",
    "The service in the church was long, but the choir sang well.", "An error in the third column made the totals wrong for a whole year.", "The connection between the two letters is easy to miss.", "They denied him access to the archive, which he had visited for years.", "The trial session ended late, and the judge left without a word.", "The museum is closed for maintenance of its roof, says the notice by the door.", "A rate limit on the river keeps the boats from damaging the banks.", "We tried again the next morning, when the wind had dropped.",
    "The template for the letter has a field for the date, which the clerk fills in.", "Printers have set lorem ipsum for centuries to show a typeface.", "Cicero's treatise on ends was the source of a famous filler passage.", "Der Server in der Küche war nicht schuld an dem Fehler, den wir gestern fanden.", "Die Seite, die fehlte, lag später unter dem Tisch.", "Le service du soir était lent, mais la soupe était bonne.", "La page manquante du registre n'a jamais été retrouvée par les archivistes.", "El servidor de la iglesia encendió las velas antes de la misa.", "La página que faltaba apareció en el cajón de la mesa.",
    "Il servizio postale era lento in quei mesi d'inverno.", "O acesso ao porto foi difícil durante toda a semana.", "De dienst begon laat omdat de dominee zijn trein miste.", "The test was hard, and only three of the students finished it.", "A quick fox crossed the road in front of the tired walkers.", "The reference number of the painting is in the catalogue of 1912.", "Her request for a longer loan was refused by the bank in March.", "On page 404 the author turns to the question of the harbour.", "Route 503 runs along the coast and stops at every village.", "The stream was interrupted by a fallen tree, so the mill stood still.",
    "Please wait for me at the station, I will bring the tickets.", "Something went missing from the kitchen, and the cook blamed the cat.", "I could not find the house you described in your last letter.", "The model sat still for three hours while the painter worked.", "The gateway to the castle was unreachable because of the flood.", "Nothing on the server's tray was what we had ordered.",
]


@pytest.fixture(scope="module")
def detector():
    """Weights as a corpus of ordinary prose gives them."""
    common = dict.fromkeys(frozenset().union(*residue.FUNCTION.values()) & residue.VOCABULARY, 600)
    return residue.Detector(*residue.weights({**dict.fromkeys(residue.VOCABULARY, 20), **common, "num": 300}, 1000))


def test_unseen_residue_is_found(detector):
    missed = [(k, t, detector.kind(t)) for k, texts in RESIDUE.items() for t in texts if detector.kind(t) is None]
    n = sum(map(len, RESIDUE.values()))
    assert n >= 85 and len(missed) <= 0.1 * n, missed


def test_unseen_residue_within_prose(detector):
    """Inside other text the same lines are found as passages of their own."""
    prose = "The harbour was quiet before noon, and nobody had opened the ledger.\n\n{}\n\nThe last ferry left without the captain, as it often did."
    texts = [t for k in ("script", "error", "filler") for t in RESIDUE[k]]
    assert sum(detector.kind(prose.format(t)) is not None for t in texts) >= 0.85 * len(texts)


def test_clean_sentences_are_left(detector):
    wrong = [(t, detector.kind(t)) for t in CLEAN if detector.kind(t)]
    assert len(CLEAN) >= 40 and not wrong, wrong
