"""The small labelled table of problem 2, written for it: frames with labelled slots, and random words to fill them.

No frame and no list of names is taken from the data. Names are put together from syllables or taken
from common ones of several languages, so that the field has to look at what stands around them.
"""

from __future__ import annotations

import random
import re

GIVEN = [
    "Anna", "Peter", "Linda", "George", "Susan", "Ahmed", "Mei", "Carlos", "Elena", "Jorge", "Claire", "Antoine", "Hélène", "François", "José", "Inés", "Raúl", "Greta", "Lars", "Ewa", "Milan", "Oksana", "Deepak", "Anjali", "Kwame", "Zainab",
    "Hiro", "Sakura", "Tomasz", "Björn", "Chloé", "Mateo", "Ximena", "Walter", "Doris", "Kevin", "Brandy", "Omar", "Leila", "Sven", "Amélie", "Nikola", "Rosa", "Emeka", "Ravi", "Gwen", "Ulrich", "Vera",
]
SURNAMES = [
    "Miller", "Brown", "Nguyen", "Patel", "Kowalski", "Schmidt", "Rossi", "Okafor", "Tanaka", "García", "Fernández", "Lefèvre", "Moreau", "Haddad", "Larsen", "Novak", "Petrov", "Adeyemi", "Hughes", "Baker", "Castillo", "Ibáñez", "Dubois", "Weber",
    "Bianchi", "Kaur", "Lindqvist", "Popescu", "Stewart", "Yamada", "Muñoz", "Girard", "Hoffman", "Osei", "Sharma", "Turner", "Vargas", "Whitaker", "Zhang", "Abbott",
]
_FIRST = ["al", "be", "cru", "da", "el", "fo", "gri", "ha", "ir", "jo", "ku", "lo", "man", "ni", "or", "pra", "qua", "ro", "sil", "ta", "ur", "vo", "wil", "ya", "ze", "ston", "mur", "hol", "bar", "tel"]
_MORE = ["ba", "den", "fa", "go", "li", "mar", "na", "pe", "ri", "so", "tu", "va", "lin", "do", "ka", "mo", "ne", "rro", "ze", "ñi", "lé", "stra", "ndo", "lli"]
_END = ["n", "s", "son", "ez", "er", "ski", "ova", "ini", "berg", "ton", "ard", "ois", "eau", "man", "ic", "os", "ia", "wood", "ley", "ko", "dal", "ham", "itz", "ero", "ák", "és"]
_STREETS = ["Cedar", "Hillcrest", "Walnut", "Lakeview", "Sunset", "Mulberry", "Harbor", "Willow", "Chestnut", "Mill", "Park", "River", "Spring", "Highland", "Washington", "Lincoln", "Orchard", "Dogwood", "Pine", "Market", "Canal", "Bayview", "Old Post", "Rose Garden"]
_KINDS = ["Street", "St", "St.", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Drive", "Dr", "Lane", "Ln", "Court", "Ct", "Parkway", "Pkwy", "Way", "Terrace", "Place", "Circle", "Trail"]
_TOWNS = ["Fairview", "Lake Arden", "Bridgeton", "East Hollow", "Clearwater", "Mount Vesta", "San Aurelio", "Bellport", "Three Rivers", "New Carden", "Port Elin", "Grand Forks"]
_CARS = ["Ford pickup", "Honda Civic", "Toyota van", "Chevrolet coupe", "Kia Soul", "Mazda 3", "Volvo wagon", "Jeep", "Nissan SUV", "Hyundai sedan", "Subaru hatchback", "Dodge Ram", "Arvana 200 sedan", "Mirello sports car", "Delton box van"]
_COLORS = ["yellow", "brown", "orange", "purple", "dark blue", "beige", "gold", "black", "white", "grey", "red"]
_ENDS = ["Towing", "Auto Body", "Garage", "Recovery", "Wrecker Service", "Collision Center", "Hospital", "Medical Center", "Clinic", "Insurance", "Motors", "& Sons Repair", "Ambulance", "Freight", "Bakery", "General", "High School", "Church", "Tire Shop", "County Hospital"]
_AGENCIES = ["Highway Patrol", "Sheriff's Office", "Fire Department", "Police Department", "County Roads Office", "State Police", "Records Unit", "Transit Authority"]
_HOSTS = ["gmx.test", "mailbox.org", "webpost.net", "company.biz", "uni.edu", "agency.gov", "freemail.co", "letters.example", "mx.example.org", "net.invalid"]
_WORDS = {
    "en": ["oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "zero"],
    "es": ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
    "fr": ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"],
}
_TITLES = ["Mr. ", "Ms. ", "Mrs. ", "Dr. ", "Mr ", "Miss ", "Prof. "]
_RANKS = ["Officer ", "Deputy ", "Sgt. ", "Det. ", "Trooper ", "Captain ", "Lt. ", "Cpl. ", "Sergeant ", "Investigator ", "Inspector ", "Ofc. "]

# Labelled frames. Slots in angle brackets are spans of the type named; those in braces are filled and not labelled.
# N a person in any form, F a full name, P a surname or given name alone, R a rank and a name.
FRAMES = [
    # persons, at the beginning
    "<N> told us the lane was clear.", "<N> says it was dark.", "<N> did not want a doctor.", "<N> drove a {COLOR} {CAR} {DIR}.", "<N> got out and waved.", "<N> had the green light, two people agree.", "<N> saw {COLOR} smoke.", "<N> braked hard near {ST}.", "<N> pulled over by {BIZ}.", "<N> wore no helmet.", "<N> owns the {CAR}.",
    "<N> apologised for the delay.", "<N> left before the crew came.", "<N> was shaken but unhurt.", "<N> was taken to {BIZ}.", "<N> was given a ticket.", "<N> was looking for {ST}.", "<N> was asleep in the rear.", "<N> has {X}.", "<N> could not recall the color.", "<N> reported {X} and went home.", "<N> and <N> swapped papers.", "<N>, the passenger, kept quiet.", "<N> \"never saw it coming\".", "<P> \"never saw it coming\".", "<P> agreed with that.", "<P> admitted the error.", "<P> helped to push the car.",
    "<N> keeps a copy.", "<N> would like to be called at <PHONE_NUMBER>.", "<N> may be reached on <PHONE_NUMBER> in the morning.", "<N> lives at <ADDRESS>.", "<N> of <ADDRESS> owns the {CAR}.", "<N> moved to <ADDRESS> in May.", "<N> has SSN <SSN>.", "<N> (SSN <SSN>) signed.", "<N> showed license <DRIVER_LICENSE>.", "<N>, license no. <DRIVER_LICENSE>, is insured.", "<N> writes from <EMAIL>.",
    "<N> declined help.", "<N> refused to sign.", "<N> stayed in the car.", "<N> ran to the phone.", "<N> opened the hood.", "<N> stated nothing further.", "<N> turned around.", "<N> returned the form.", "<N> changed lanes.", "<N> parked in front.", "<N> phoned home.", "<N> noticed a leak.", "<N> walked home.", "<N> called from {TOWN}.", "<N> complained about the noise.", "<N> started the engine.",
    # persons, within
    "The driver, <N>, waited.", "The caller was <N>.", "A neighbor named <N> called it in.", "It belongs to <N>.", "We met <N> at the gate.", "According to the note, <N> turned left.", "As <N> put it, nobody could have stopped.", "Statement of <N> is attached.", "A talk with <N> is planned.", "I asked <N> about the tires.", "She married <N> last year.", "Her son <N> was in the back.", "His wife <N> drove.", "Injured: <N>.", "Owner: <N>", "Witness <N> heard a bang.", "Witnesses <N> and <N> heard a bang.", "Passenger <N> slept.", "Claimant <N> asks for a copy.", "Adjuster <N> will call.", "Adjuster <N> of {BIZ} will call.", "Adjuster <N>, <EMAIL>, will call.", "Reported by <R>.", "<R> closed the road.", "<R> took photographs.", "I, <R>, spoke with <N>.", "<R> and <R> arrived first.", "Paramedic <N> dressed the wound.", "The mother of <N> was told.", "The {CAR} of <N> was towed by {BIZ}.", "A nurse told <N> to rest.", "The bag of <N> was found on {ST}.", "Later <P> changed the story.", "Then <P> and <P> argued.", "We could not find <P>.", "In the end <P> paid.", "Both <P> and <P> were cited.", "Relatives of <N> were called at <PHONE_NUMBER>.", "Contact <N> at <EMAIL> or <PHONE_NUMBER>.",
    # numbers and addresses
    "Call <PHONE_NUMBER>.", "Phone: <PHONE_NUMBER>", "Cell <PHONE_NUMBER>, home <PHONE_NUMBER>.", "Phone numbers <PHONE_NUMBER> and <PHONE_NUMBER> do not work.", "Tel. <PHONE_NUMBER>", "The number given (<PHONE_NUMBER>) is out of service.", "Reach us under <PHONE_NUMBER> or <EMAIL>.", "A text came from <PHONE_NUMBER>.", "The office line is <PHONE_NUMBER>, ask for <N>.", "E-mail: <EMAIL>", "Photos go to <EMAIL>.", "Send it to <EMAIL>, please.", "He wrote from <EMAIL> on {TIME}.", "Social security no. <SSN>.", "SSN: <SSN>", "Soc. sec. <SSN> is on the card.", "The social is <SSN>.", "Taxpayer or social number <SSN>; driver license <DRIVER_LICENSE>.", "License <DRIVER_LICENSE> had expired.", "DL# <DRIVER_LICENSE>", "DL <DRIVER_LICENSE> came back valid.", "Operator's license <DRIVER_LICENSE>, class C.", "Driver's license number <DRIVER_LICENSE> belongs to <N>.", "The license with the number <DRIVER_LICENSE> was kept.", "Address: <ADDRESS>", "The house is at <ADDRESS>.", "Mail goes to <ADDRESS>.", "It happened outside <ADDRESS>, where <N> lives.", "Bills were sent to <ADDRESS> and came back.", "Residence <ADDRESS>.", "He gave <ADDRESS> as home.",
    # Spanish and French
    "<N> dijo que frenó a tiempo.", "<N> no recuerda nada.", "<N> conducía un {CAR} {COLOR}.", "<N> fue llevado a {BIZ}.", "<N> vio el choque desde la tienda.", "Declaró <N> que llovía.", "El conductor, <N>, esperó.", "La señora <N> llamó a su hija.", "El señor <N> pagó.", "Testigo: <N>.", "La testigo <N> oyó un golpe.", "Habló con <N> por teléfono.", "El agente <N> tomó fotos.", "Como dijo <N>, nadie pudo parar.", "Se avisó a <N> al <PHONE_NUMBER>.", "Teléfono: <PHONE_NUMBER>", "Su número es <PHONE_NUMBER> y escribe desde <EMAIL>.", "Correo: <EMAIL>", "Licencia <DRIVER_LICENSE> vigente.", "Mostró la licencia número <DRIVER_LICENSE>.", "Seguro social <SSN>.", "Domicilio: <ADDRES>.", "<N> reside en <ADDRES>.", "La casa está en <ADDRES>.", "<P> no quiso hablar.", "<P> esperó afuera.",
    "<N> dit avoir freiné à temps.", "<N> ne se souvient de rien.", "<N> conduisait une {CAR}.", "<N> est resté sur place.", "<N> a vu le choc de la boutique.", "<N> s'est garé devant {BIZ}.", "<N> n'a rien vu.", "D'après <N>, il pleuvait.", "Le conducteur, <N>, attendait.", "Madame <N> a appelé sa fille.", "Monsieur <N> a payé.", "Témoin : <N>.", "Le témoin <N> a entendu un bruit.", "On a parlé avec <N> hier.", "L'agent <N> a pris des photos.", "Appeler <N> au <PHONE_NUMBER>.", "Téléphone : <PHONE_NUMBER>", "Son numéro est le <PHONE_NUMBER>, son courriel <EMAIL>.", "Courriel : <EMAIL>", "Permis <DRIVER_LICENSE> valable.", "Numéro de permis <DRIVER_LICENSE>.", "Adresse : <ADDREF>.", "<N> demeure au <ADDREF>.", "La maison est au <ADDREF>.", "<P> a refusé de parler.",
    # without spans
    "The {COLOR} {CAR} rolled back.", "The {CAR} was towed by {BIZ}.", "{BIZ} took the {CAR} away.", "A truck of {BIZ} blocked {ST}.", "The ad for {BIZ} hangs at {ST}.", "They met at {ST} and {ST}.", "{ST} was closed.", "Traffic on {ST} was slow.", "The curve of {ST} near {TOWN} is wet.", "In {TOWN} the road narrows.", "The {AGENCY} of {TOWN} came.", "{AGENCY} unit {N} came.", "{TOWN} {AGENCY}, form {D5}.", "The {GS} Bridge was icy.", "They took the {GS} Expressway to {TOWN}.", "{GS} Memorial Bridge is closed at night.", "The {GS} Parkway exit was flooded.", "{GS} Highway has two lanes.", "The 2300 block of {ST} has lights.", "In the {N}00 block of {ST} a tree fell.", "Route {N} and Highway {D3} cross here.", "County Road {N} is gravel.", "Exit {N} was shut.", "Mile {D3} on Interstate {N}.",
    "VIN {VIN} was read twice.", "The VIN {VIN} belongs to the {CAR}.", "Plate {PLATE} was run.", "Tag {PLATE} is out of state.", "Policy {PLATE}{D5} lapsed.", "Policy no. {D3}-{D7} is active.", "Claim {D3}-{N}-{D4} is open.", "Invoice {D3}-{N}-{D4} was paid.", "Order number {D3}-{N}-{D4} is late.", "Case {N}-{D5} is closed.", "Incident {PLATE} at {TIME}.", "Ticket {D7} was voided.", "Badge {D4} wrote this.", "Unit {D4} assisted.", "Account {D7} was billed {D3} dollars.", "Mileage {D3},{D3}.", "Serial {HEX} was logged.", "Hash {HEX} matches.", "The tag @{STL}_news posted it.", "A post by @{STL}{N} shows the {CAR}.", "Meter {D5} was off.", "At {TIME} the road was open again.", "It was {TIME} when the crew left.", "About {N} feet of rail were bent.", "The speed was {N} mph.", "{N} percent of the brake was left.", "Speed={N};gear={D};door=0.", "See page {N}, photo {N}.", "Unit {D} hit Unit {D}.", "The driver of Unit {D} was calm.", "The driver of the {CAR} was calm.",
    "{TOWN} {AGENCY} - Accident Form", "{TOWN} {AGENCY}  Page {D} of {N}", "FORM {PLATE} REV. {D}", "Form No. {PLATE} Rev. {D}", "Form Report QX-{D3} Rev. {D}", "Restricted / {AGENCY}", "Addendum to Case {N}-{D5}   - {D} -", "Traffic Report Continuation Sheet  No. {D5}", "Page {N}", "- {N} -", "[{D}]", "{D} of {N}", "Report {D5} / {TOWN}",
    "Nobody was hurt.", "The road was dry and the sky was clear.", "Glass lay in both lanes.", "The pedestrian crossed in front of a bus.", "Several people helped.", "The Department asks for patience.", "No names were given.", "An Ambulance came at once.", "Both Drivers left.", "The Medical Center is near.", "Airbags opened.", "The Event Recorder was read.", "Photographs were taken by the crew.", "When asked, the driver shrugged.", "During the night it snowed.", "Because of the fog, nobody saw the pole.", "Estimated loss: {D4} dollars.", "Heading {DIR}, the {CAR} slid.", "Damage was light.", "Low tires were noted.", "Respectfully, unit {D}",
    "El {CAR} se detuvo.", "La carretera estaba seca.", "La unidad {D} chocó con la unidad {D}.", "Los daños fueron leves.", "Nadie resultó herido.", "Cerca de {ST} hay una escuela.", "La grúa de {BIZ} llegó a las {TIME}.", "Se midieron {N} metros.", "Quedan {N} testigos.", "Según el mapa, hay {N} salidas.", "Por la noche nevó.", "Policía de {TOWN}, caso {D5}.",
    "La {CAR} s'est arrêtée.", "La route était sèche.", "L'unité {D} a heurté l'unité {D}.", "Les dégâts sont légers.", "Personne n'est blessé.", "Près de {ST} il y a une école.", "La dépanneuse de {BIZ} est venue à {TIME}.", "On a mesuré {N} mètres.", "Selon le plan, il y a {N} sorties.", "Pendant la nuit il a neigé.", "Police de {TOWN}, dossier {D5}.",
]
LEADS = ["", "", "", "", "", "", "Around noon ", "Later that day, ", "Before that, ", "To my knowledge, ", "At {TIME} ", "After the crash, ", "On arrival, ", "In short, ", "As noted, ", "For now, ", "Luego, ", "Más tarde, ", "A las {TIME}, ", "Ensuite, ", "Plus tard, ", "À {TIME}, "]
TRAILS = ["", "", "", "", "", "", ", as said", ", see photo {N}", " (item {N})", "; that was all", ", it seems", " - checked twice", ", como consta", ", comme indiqué"]


class Filler:
    """Fills slots from a seeded random generator."""

    def __init__(self, seed: int = 1):
        self.r = random.Random(seed)

    def one(self, xs):
        return xs[self.r.randrange(len(xs))]

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def word(self) -> str:
        """A made-up word, as a name or a part of one can be."""
        return (self.one(_FIRST) + "".join(self.one(_MORE) for _ in range(self.r.choice((0, 0, 1, 1, 2)))) + self.one(_END)).capitalize()

    def surname(self) -> str:
        name = self.one(SURNAMES) if self.r.random() < 0.25 else self.word()
        x = self.r.random()
        return f"O'{name}" if x < 0.06 else self.one(["de la ", "de ", "van ", "du "]) + name if x < 0.12 else f"Mc{name}" if x < 0.14 else name

    def given(self) -> str:
        return self.one(GIVEN) if self.r.random() < 0.4 else self.word()

    def name(self) -> tuple[str, str]:
        """(title, name)"""
        r = self.r
        s = self.surname() if r.random() > 0.12 else f"{self.surname()}-{self.word()}"
        g, kind = self.given(), r.random()
        if kind < 0.16:
            return self.one([*_TITLES, "Sr. ", "Sra. ", "M. ", "Mme "]), s
        if kind < 0.22:
            return self.one([*_TITLES, "M. ", "Sr. "]), f"{self.one('ABCDEFGHIJKLMNOPRSTVWYZÉ')}. {s}"
        full = f"{g} {s}" if kind < 0.58 else f"{g} {self.one('ABCDEFGHJKLMNPRSTW')}. {s}" if kind < 0.68 else f"{s.upper()}, {g}" if kind < 0.78 else s if kind < 0.85 else g if kind < 0.91 else f"{g} {s}".lower() if kind < 0.96 else f"{g} {s}".upper()
        return "", full

    def phone(self) -> str:
        a, b, c = self.digits(3), self.one(["555", self.digits(3)]), self.digits(4)
        if self.r.random() < 0.12:
            words = _WORDS[self.one(["en", "en", "es", "fr"])]
            say = [self.one(words) for _ in range(7)]
            return self.one([f"{' '.join(say[:3])}, {' '.join(say[3:])}", " ".join(say), f"{' '.join(say[:3])} - {' '.join(say[3:])}"])
        return self.one([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"{a}{b}{c}", f"1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+33 {self.digits(1)} {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)}", f"+44 {self.digits(4)} {self.digits(6)}", f"+34{self.digits(9)}", f"+1{a}{b}{c}"])

    def email(self) -> str:
        def bare(x: str) -> str:
            return re.sub(r"[^a-z]", "", x.lower().translate(str.maketrans("áéèíñóúöê", "aeeinouoe")))

        g, s = bare(self.given()), bare(self.surname())
        local = self.one([f"{g}.{s}", f"{g}_{s}", f"{s}{self.digits(2)}", f"{g}+news", f"{s}-{g[0]}", f"{g[0]}{s}", g, f"{g}{self.digits(3)}"])
        host = self.one(_HOSTS) if self.r.random() < 0.5 else f"{bare(self.word())}.{self.one(['com', 'org', 'net', 'example', 'co.uk'])}"
        mail = f"{local}@{host}" if self.r.random() < 0.65 else f"{local} {self.one(['(at)', 'at', '[at]', '(AT)'])} {host.replace('.', self.one([' dot ', ' (dot) ', ' dot ']))}"
        return mail.upper() if self.r.random() < 0.08 else mail

    def ssn(self) -> str:
        a, b, c = self.digits(3), self.digits(2), self.digits(4)
        return self.one([f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"{a} {b} {c}", f"{a} - {b} - {c}"])

    def license(self) -> str:
        x, y = self.one("ABCDEFGHJKLMNPRSTUVWYZ"), self.one("ABCDEFGHJKLMNPRSTUVWYZ")
        return self.one([f"{x}{y}{self.digits(8)}", f"{x} {self.digits(3)} {self.digits(3)} {self.digits(3)}", f"{x}{self.digits(self.r.randrange(6, 13))}", f"{self.digits(3)}{x}{self.digits(5)}", f"{x}{self.digits(4)}-{self.digits(4)}-{self.digits(2)}", f"{self.digits(2)}-{self.digits(3)}-{self.digits(4)}-{x}"])

    def street(self) -> str:
        return f"{self.one(_STREETS) if self.r.random() < 0.5 else self.word()} {self.one(_KINDS)}"

    def address(self) -> str:
        r, town = self.r, self.one(_TOWNS) if self.r.random() < 0.5 else self.word()
        base = f"{self.digits(r.randrange(2, 6)).lstrip('0') or '7'} {self.one(['', '', '', 'N ', 'SW ', 'East ', 'North ', 'W. '])}{self.street()}"
        base = self.one([base, base, base, base, base, f"PO Box {self.digits(r.randrange(2, 5))}", f"RR {self.digits(1)} Box {self.digits(r.randrange(2, 4))}", f"P.O. Box {self.digits(3)}", f"Rural Route {self.digits(1)}, Box {self.digits(2)}"])
        unit = self.one(["", "", "", f", Apt {self.digits(2)}", f" Unit {self.digits(2)}", f", Lot {self.digits(2)}", f", #{self.digits(2)}", f", Suite {self.digits(3)}", f" Apt. {self.one('ABCD')}"])
        state = f"{self.one('ABCDEFGIKLMNOPQRSTUVWXZ')}{self.one('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}"
        return base + unit + self.one(["", f", {town}, {state} {self.digits(5)}", f", {town}, {state} {self.digits(5)}", f" in {town}", f", {town}"])

    def slot(self, name: str) -> str:
        r = self.r
        match name:
            case "X": return self.one(["a sore back", "a cut hand", "neck stiffness", "no pain", "a bruised knee", "a headache"])
            case "BIZ": return f"{self.one(['', '', 'Saint ', 'New '])}{self.word() if r.random() < 0.7 else self.one(_TOWNS)} {self.one(_ENDS)}"
            case "ST": return self.street()
            case "STL": return self.word().lower()
            case "COLOR": return self.one(_COLORS)
            case "CAR": return self.one(_CARS) if r.random() < 0.5 else f"{self.word()} {self.one(['sedan', 'van', 'coupe', 'truck', 'SUV', 'Sport', 'pickup', self.digits(3)])}"
            case "DIR": return self.one(["northbound", "southbound", "eastbound", "westbound"])
            case "TOWN": return self.one(_TOWNS) if r.random() < 0.6 else self.word()
            case "AGENCY": return self.one(_AGENCIES)
            case "GS": return f"{self.given()} {self.surname()}"
            case "VIN": return "".join(self.one("ABCDEFGHJKLMNPRSTUVWXYZ0123456789") for _ in range(17))
            case "HEX": return "".join(self.one("abcdef0123456789") for _ in range(r.randrange(12, 65)))
            case "PLATE": return "".join(self.one("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(r.choice((2, 3)))) + self.one([" ", "-", ""]) + self.digits(r.choice((3, 4)))
            case "TIME": return self.one([f"{r.randrange(1, 13)}:{self.digits(2)} {self.one(['AM', 'PM', 'p.m.', 'a.m.'])}", self.digits(4), f"{self.digits(2)}:{self.digits(2)}", f"{self.digits(4)} hrs"])
            case "N": return str(r.randrange(1, 100))
            case _: return self.digits(int(name[1:] or 1))

    def span(self, name: str) -> tuple[str, str, str]:
        """(text before, label, text of the span)"""
        match name:
            case "N":
                title, n = self.name()
                return title, "PERSON_NAME", n
            case "P": return "", "PERSON_NAME", self.one([self.surname(), self.given()])
            case "R":
                title, n = self.name()
                return self.one(_RANKS), "PERSON_NAME", n
            case "PHONE_NUMBER": return "", name, self.phone()
            case "EMAIL": return "", name, self.email()
            case "SSN": return "", name, self.ssn()
            case "DRIVER_LICENSE": return "", name, self.license()
            case "ADDRES": return "", "ADDRESS", f"{self.one(['Calle', 'Avenida', 'Camino', 'C.'])} {self.one(_STREETS) if self.r.random() < 0.4 else self.word()} {self.one(['', 'núm. ', 'n.º ', '#'])}{self.digits(self.r.randrange(1, 5)).lstrip('0') or '3'}{self.one(['', f', piso {self.digits(1)}', f', casa {self.digits(1)}', f', apto. {self.digits(1)}'])}"
            case "ADDREF": return "", "ADDRESS", f"{self.digits(self.r.randrange(1, 4)).lstrip('0') or '5'}{self.one([',', '', ' bis'])} {self.one(['rue', 'avenue', 'boulevard', 'chemin', 'place'])} {self.one(['de la ', '', 'du ', 'des '])}{self.one(_STREETS) if self.r.random() < 0.4 else self.word()}"
            case _: return "", "ADDRESS", self.address()


def rows(n: int = 4200, seed: int = 1, frames: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with labelled spans (start, end, type): the frames filled again and again, some in capitals, some broken over lines."""
    f, out, frames = Filler(seed), [], frames or FRAMES
    for i in range(n):
        pattern = frames[i % len(frames)]
        lead, trail = f.one(LEADS), f.one(TRAILS)
        pattern = lead + (pattern if not lead or pattern[0] in "<{" or f.r.random() < 0.4 else pattern[0].lower() + pattern[1:])
        pattern = pattern[:-1] + trail + "." if pattern.endswith(".") else pattern
        text, spans = "", []
        for part in re.split(r"(<\w+>|\{\w+\})", pattern):
            if part.startswith("<"):
                before, label, value = f.span(part[1:-1])
                text += before
                spans.append((len(text), len(text) + len(value), label))
                text += value
            else:
                text += f.slot(part[1:-1]) if part.startswith("{") else part
        x = f.r.random()
        if x < 0.25:
            up = text.upper()
            text = up if len(up) == len(text) else text
        elif x < 0.3:
            text = text.lower()
        if f.r.random() < 0.25:  # lines end where they end
            cut = [m.start() for m in re.finditer(" ", text)]
            if cut:
                at = f.one(cut)
                text = text[:at] + "\n" + text[at + 1 :]
        out.append((text, spans))
    return out
