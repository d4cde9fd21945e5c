"""Labelled spans to train on, made by rule from public formats, a name lexicon and sentences of our own.

Items are put into frames written here, or bare between the words of a text that holds no item. A part of the frames and
formats is held out: texts made with ``held=True`` use only those, texts to train on never do.
"""

from __future__ import annotations

import random
import re

import numpy as np

from palimpsest.llm.pii.model import TRAINED, TYPES, char_codes

#: Common names of many countries.
GIVEN = (
    "Maria James Anna John Elena Peter Sofia David Laura Thomas Julia Michael Sarah Daniel Emma Robert Linda Paul Karin Ahmed Fatima Omar Layla Yusuf Priya Arjun Ananya Rahul Wei Mei Hiroshi Yuki Kenji "
    "Chloé François Amélie Étienne Zoë Björn Åsa Jürgen Käthe Matthias Ingrid Sven Lars Freya Mateo Lucía José Camila João Beatriz Giulia Marco Chiara Piotr Agnieszka Zofia Tomáš Jana László Ilona "
    "Dimitri Olga Ivan Svetlana Nikos Eleni Mehmet Ayşe Kwame Amara Chidi Zanele Thabo Noa Avi Siobhán Liam Aoife Rhys Megan Bruce Sheila Kevin Nancy Gary Tiffany Иван Ольга Сергей Νίκος Ελένη"
).split()
FAMILY = (
    "Smith Johnson Brown Miller Davis Wilson Taylor Clark Lewis Walker Young Wright Green Baker Carter Müller Schmidt Schneider Fischer Weber Becker Hoffmann Schäfer Martin Bernard Dubois Moreau Lefèvre Girard "
    "García Fernández López Martínez Núñez Silva Santos Oliveira Rossi Russo Ferrari Bianchi Andersson Johansson Lindqvist Hansen Nielsen Sørensen Virtanen Korhonen Kowalski Nowak Wiśniewska Novák Dvořák Nagy "
    "Kovács Popescu Ivanov Petrova Sokolov Papadopoulos Yılmaz Demir Khan Hussain Sharma Patel Raman Singh Gupta Chen Wang Zhang Liu Tanaka Suzuki Kim Park Nguyen Okafor Mensah Dlamini Cohen Levi Murphy O'Connor "
    "O'Brien Byrne MacLeod Jones Evans Иванов Петрова Παππάς"
).split()
_ONSET = "b bl br c ch cr d dr f fl fr g gl gr h j k kl kr l m n p pl pr qu r s sc sh sk sl sp st str t th tr v w y z".split()
_VOWEL = "a e i o u y ae ai ea ee ia ie io oa oo ou ue é ö å".split()
_CODA = ["", "", "", "b", "ck", "d", "g", "l", "ld", "ll", "m", "n", "nd", "ng", "nt", "p", "r", "rd", "rt", "s", "ss", "st", "t", "th", "x"]
_ENDING = "a an as e el en er ez i ia ic in ini is man o off on os ov ova sen ski son sson strand ström ton us well wood".split()
_LANE = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Close Crescent Terrace Way Place Square Boulevard Blvd Grove Hill Gardens Row Walk Parkway".split()
_BEFORE = "rue de la|rue du|rue des|rue de|rue|avenue de|avenue du|boulevard du|chemin de la|impasse des|place du|calle|calle de la|avenida de|paseo de|plaza|via|via del|viale|piazza|corso|rua|rua da|largo do|ul.|aleja|Calle|Rue|Via|Avenida|Rua".split("|")
_JOINED = "straße strasse str. gasse weg allee platz ring damm ufer gatan vägen stigen gränd vej gade veien gata straat laan katu tie".split()

#: Frames around one item; {x} is the item. Every fifth frame of a list is held out.
FRAMES = {
    "email": [
        "please forward it to {x} today", "my inbox is {x}", "E-mail: {x}", "reach me under {x} any time", "sent from {x} to the list", "you can mail {x} directly", "account {x} was locked", "invite {x} as a guest",
        "the newsletter goes to {x}, weekly", "subscribe {x} to the feed", "from: {x}", "to: {x};", "reply-to {x}", "a message by {x} arrived", "send the invoice to {x}.", "Kontakt: {x}", "Bitte schreiben Sie an {x}.",
        "écrivez à {x} svp", "escriba a {x} por favor", "skriv till {x}", "[mail]({x})", "user {x} signed up", "{x} has no mailbox here", "write me: {x}", "<{x}> wrote:", "href=\"mailto:{x}\"", "address book entry {x}", "the alias {x} expired", "{x} is my work mail", "ask {x} for access",
    ],
    "phone": [
        "you can phone us on {x}", "Tel.: {x}", "Phone number {x}", "my cell is {x}", "dial {x} and wait", "the hotline is {x}", "text me at {x}", "her number, {x}, is busy", "fax to {x}", "WhatsApp {x}", "ring {x} tonight", "left a voicemail from {x}", "missed call: {x}",
        "emergency contact {x}", "Telefon {x}", "Rufen Sie {x} an.", "appelez le {x}", "llame al {x}", "ring {x} i morgon", "T {x}", "(phone {x})", "sms to {x} failed", "it was {x} who called", "the office line {x} is new", "{x} rang twice", "handset {x}", "call-back number {x}", "reach the desk under {x}", "the landline {x} stays", "pager {x}",
    ],
    "national_id": [
        "social security number {x}", "tax number {x}", "ID card {x}", "his passport no. {x} expires", "Personalausweis {x}", "national insurance no {x}", "citizen id: {x}", "personnummer {x}", "the applicant's number is {x}", "DNI {x}", "NIE: {x}", "identity document {x} was scanned", "CPF {x}",
        "code fiscal {x}", "registered under {x}", "birth number {x}", "proof of identity {x}", "BSN {x}", "the ID reads {x}", "Steuer-ID {x}", "id number {x} verified", "numéro de sécurité sociale {x}", "{x} is her social security number", "SSN: {x}", "personal id {x} matches", "ident {x}", "government id {x}", "passport {x} was copied", "insurance id {x} given", "NINO {x}",
    ],
    "address": [
        "we are at {x}", "My address is {x}", "send the parcel to {x}", "visit us: {x}", "home: {x}", "Office at {x}, second floor", "she rents a room in {x}", "the meeting is held at {x}", "billing address {x}", "Ich wohne in der {x}", "Adresse: {x}", "j'habite {x}", "vivo en {x}", "jag bor på {x}",
        "the shop on {x} closed", "pick it up from {x} please", "directions to {x}", "an ambulance reached {x}", "they relocated to {x}", "street: {x}", "the house at {x} burned", "born at {x}", "mail goes to {x} now", "return to {x}", "her flat, {x}, is small", "{x} is our new place", "located at {x}", "stays at {x} this week", "the garage behind {x}", "from {x} to the station",
    ],
    "person_name": [
        "Dear {x},", "best wishes, {x}", "Yours sincerely {x}", "Kind regards, {x}", "warm regards\n{x}", "many thanks, {x}", "I met {x} yesterday", "a call with {x} went well", "Ms. {x} will join", "Mr {x} has left", "Prof. {x} gave a talk", "her name is {x}", "Name: {x}", "name={x}", "author {x}", "written by {x}", "{x} wrote the report", "{x} said no", "{x} and the team agreed",
        "ask {x} about it", "thanks to {x} for this", "assigned to {x}", "the patient {x} recovered", "customer {x} complained", "client {x}, second visit", "Herr {x} ist krank", "Frau {x} kommt später", "Monsieur {x} est parti", "señora {x} llamó", "with {x} on leave, nobody answers", "{x}'s laptop broke", "contact person: {x}", "met with {x} and left",
        "user {x} logged in", "attn {x}", "this is {x} speaking", "hired {x} last year", "{x} resigned", "invoice for {x}", "the witness, {x}, stayed", "approved: {x}", "by {x}, 2019", "as {x} put it",
    ],
}
_KEYS = {
    "email": "email e_mail mailbox work_email mail_address user_mail sender recipient".split(), "phone": "phone phone_number mobile_phone cell fax telephone call_back number".split(),
    "national_id": "ssn tax_id passport_no personal_id id_number national_id document_no citizen_no".split(), "address": "street address address_line home_address street_address location delivery billing".split(),
    "person_name": "name full_name display_name contact_name customer_name author owner employee signed_by".split(),
}
#: Sentences without items, of our own; {w} and {v} are words, {n} numbers.
_PLAIN = [
    "Chapter {n} explains how {w} works.", "On {w} the {w} was not ready.", "Page {n} lists {n} errors.", "Room {n} is closed until Monday Morning.", "The {w} Team met in North Hall.", "Visual Studio and Google Drive were open.", "New York is far from Los Angeles.", "Version {n}.{n} came out in Spring {n}.",
    "Der große {v} steht neben dem Haus {v}.", "Die Abteilung {v} prüft das Protokoll {v} erneut.", "Das Ergebnis {v} zeigt die Größe {v}.", "La grande maison {v} attend la liste {v}.", "El equipo {v} cambió la reunión {v} ayer.", "Den gamla listan {v} väntar på rapporten {v}.", "Step {n}: open {w} and press Enter.", "{n} of {n} Tests passed, {n} skipped.",
    "About {n} {v} were moved to {w}.", "Section {n} Overview", "User Guide, Part {n}", "Total Cost: {n}.{n} EUR", "Happy Birthday, everyone!", "The Red Cross and the World Bank agreed.", "Table {n} shows {n} {v} per {v}.", "Keine Antwort von der Gruppe {v} am Freitag.", "user: Why did {w} fail? agent: {w} ran out of memory.", "Yesterday Morning {w} restarted.",
    "- Changed: {W} {v} now {v}", "# {W} {W} notes", "{W} is what {w} needs.", "{W} {v} {n} {v}.", "Only {W} and {W} remain.", "see {w}, {w} and {W} {v}", "TODO {W}: {v}", "There are {n} ways to {v} and {n} roads to {w}.",
]


def kept(things: list, held: bool) -> list:
    """The part of a list that is held out, every fifth, or the rest."""
    return [t for i, t in enumerate(things) if (i % 5 == 4) == held]


class Maker:
    """Texts with labelled items. ``background`` are texts that hold none."""

    def __init__(self, given: list[str], family: list[str], background: list[str], seed: int = 1, held: bool = False):
        self.r, self.held = random.Random(seed), held
        self.given, self.family, self.background = given, family, background
        self.frames = {k: kept(v, held) for k, v in FRAMES.items()}

    # --- words ---

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def stem(self, parts: int) -> str:
        return "".join(self.r.choice(_ONSET) + self.r.choice(_VOWEL) + self.r.choice(_CODA) for _ in range(parts))

    def word(self) -> str:
        w = self.stem(self.r.choice([1, 2, 2, 3]))
        w = w.capitalize() if self.r.random() < 0.4 else w
        return w + (f"-{self.r.randint(1, 99)}" if self.r.random() < 0.1 else "")

    def _name(self, listed: list[str], common: list[str]) -> str:
        roll = self.r.random()
        if roll < 0.25 and listed:
            return self.r.choice(listed)
        if roll < 0.6:
            return self.r.choice(common)
        return (self.stem(self.r.choice([1, 1, 2])) + self.r.choice(_ENDING)).capitalize()

    def a_given(self) -> str:
        g = self._name(self.given, kept(GIVEN, self.held))
        return f"{g}-{self._name(self.given, GIVEN)}" if self.r.random() < 0.03 else g

    def a_family(self) -> str:
        one = self._name(self.family, kept(FAMILY, self.held))
        roll = self.r.random()
        if roll < 0.1:
            return self.r.choice(["van ", "von ", "de ", "van der ", "di ", "Mc", "O'", "O’", "Mac", "al-", "D'"]) + one
        return f"{one}-{self._name(self.family, FAMILY)}" if roll < 0.17 else one

    # --- items ---

    def person_name(self) -> str:
        g, f = self.a_given(), self.a_family()
        i, j = self.r.choice("ABCDEFGHIJKLMNOPRSTVWZ"), self.r.choice("ABCDEFGHJKLMNPRSTW")
        x = self.r.choices([f"{g} {f}", f"{g} {i}. {f}", f"{i}. {f}", f"{f}, {g}", f"{i}. {j}. {f}", f"{f}, {i}.", f"{f}, {g} {i}."], [50, 13, 13, 14, 4, 3, 3])[0]
        return x.upper() if self.r.random() < 0.03 else x

    def email(self) -> str:
        r = self.r
        plain = lambda s: re.sub(r"[^a-z0-9é]", "", s.lower())
        g, f = plain(self.a_given()) or "a", plain(self.a_family()) or "b"
        sep = r.choice([".", "_", "-", ""])
        user = r.choice([f"{g}{sep}{f}", f"{g}{sep}{f}{r.randint(1, 9999)}", f"{g[0]}{sep}{f}", f"{f}{sep}{g}", g, f"{f}{r.randint(1, 99)}", f"{self.stem(2)}{sep}{self.stem(1)}", r.choice(["info", "sales", "office", "no-reply"])])
        user += r.choices(["", "+" + r.choice(["news", "shop", self.stem(1), str(r.randint(1, 99))])], [85, 15])[0]
        name = self.stem(r.choice([1, 2, 2, 3])) + r.choices(["", f"-{self.stem(1)}", str(r.randint(1, 99))], [80, 12, 8])[0]
        end = r.choice(["com", "org", "net", "de", "fr", "co.uk", "io", "edu", "se", "es", "info", self.stem(1) + "x", self.stem(2), f"co.{self.stem(1)}"])
        host = r.choices([f"{name}.{end}", f"{r.choice(['mail', 'smtp', 'post', self.stem(1)])}.{name}.{end}"], [75, 25])[0]
        ways = ["@", " (at) ", "%40", " at ", " @ ", "&#64;", "[at]", " [at] ", " AT ", "(at)", "@​", "​@"]
        at = r.choices(ways, [56, 6, 5, 6, 5, 4, 3, 4, 4, 3, 2, 2])[0]
        if at.strip("()[] ").lower() == "at" and r.random() < 0.6:
            host = host.replace(".", r.choice([" dot ", " (dot) ", " [dot] ", "(dot)", "[dot]"] if at != " AT " else [" DOT ", " dot "]))
        x = user + at + host
        return x.upper() if r.random() < 0.06 else x

    def phone(self) -> str:
        r, d = self.r, self.digits
        sep = r.choices([" ", "-", ".", "", "/", "–"], [46, 22, 9, 14, 3, 6])[0]
        if r.random() < 0.4:  # the plan of ten digits
            a, b, c = r.choice("23456789") + d(2), r.choice("23456789") + d(2), d(4)
            area = r.choices([f"({a}) ", a + sep, f"({a}){sep}", f"{a}/"], [32, 58, 6, 4])[0]
            head = r.choices(["", "+1 ", "+1", f"+1{sep}", "1-", "1 ", "001 ", "+1/"], [52, 14, 6, 9, 5, 6, 3, 5])[0]
            return head + area + b + (sep or r.choice(["", "-"])) + c
        land = r.choice("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 351 353 358 420 52 55 61 64 65 81 82 86 90 91 971".split())
        area, n = r.choice("123456789") + d(r.choice([0, 1, 1, 2, 3])), r.choice([5, 6, 6, 7, 7, 8])
        cuts = r.choice([[n], [3, n - 3], [n - 4, 4], [2] * (n // 2) + [n % 2], [3, 2, n - 5], [n - 2, 2], [4, n - 4]])
        rest = sep.join(d(k) for k in cuts if k > 0)
        joint = r.choice([" ", "-", sep, sep, "/"])
        head = r.choices([f"+{land}{r.choice([' ', sep, '-', ''])}{r.choices(['', '(0)', '(0) '], [80, 14, 6])[0]}{area}", f"0{area}", f"(0{area})", f"00{land} {area}"], [48, 40, 5, 7])[0]
        return head + joint + rest

    def national_id(self) -> str:
        r, d = self.r, self.digits
        day, month, year = f"{r.randint(1, 28):02}", f"{r.randint(1, 12):02}", d(2)
        up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
        s = r.choices(["-", " ", ".", ""], [45, 22, 10, 23])[0]
        whole = [
            f"{d(3)}{s}{d(2)}{s}{d(4)}", f"{d(3)}{s}{d(2)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(3)}", f"{up(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{up(1)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}",
            f"{up(2)}{s}{d(6)}{s}{up(1)}", f"{year}{month}{day}{r.choice('-+')}{d(4)}", f"{r.choice(['18', '19', '19', '20'])}{year}{month}{day}{r.choice(['-', '-', '', '+'])}{d(4)}", f"{up(1)}{s}{d(7)}{s}{up(1)}", f"756.{d(4)}.{d(4)}.{d(2)}",
            f"{up(1)}{d(8)}", f"{up(1)}{d(2)}{s}{d(6)}", f"{d(8)}{r.choice(['-', ''])}{up(1)}", f"{day}{month}{year}-{d(4)}", f"{d(4)}{s}{d(4)}{s}{d(4)}",
            f"{up(1)}{d(2)}{s}{d(6)}", f"{day}{month}{year}{r.choice('-A+')}{d(3)}{up(1)}", f"{d(6)} {d(5)}", f"{up(2)}{d(6)}{up(1)}", f"{d(7)}{up(2)}",
        ]
        x = r.choice(kept(whole, self.held))
        return x.lower() if r.random() < 0.08 else x

    def address(self) -> tuple[str, str, str]:
        """(before, street line, after): flat, and postcode and town, stand around the item."""
        r = self.r
        name = self.stem(r.choice([1, 2, 2])).capitalize() if r.random() < 0.7 else r.choice(kept(["High", "Church", "Victoria", "Mill", "Park", "Station", "Linden", "Goethe", "Schiller", "Garibaldi", "Mayor", "Kungs", "Berg", "Oak", "Baker", "Rosenheimer", "Republic"], self.held))
        no = r.choices([f"{r.randint(1, 250)}", f"{r.randint(1, 250)}{r.choice('abcdABC')}", f"{r.randint(1, 99)}-{r.randint(1, 99)}"], [80, 15, 5])[0]
        small, joined, sep = r.choice(kept(_BEFORE, self.held)), r.choice(kept(_JOINED, self.held)), r.choice([" ", " ", ", "])
        line = r.choices([f"{no} {name} {r.choice(kept(_LANE, self.held))}", f"{no}{sep}{small} {name}", f"{small} {name}{sep}{no}", f"{name}{joined} {no}", f"{name} {joined.capitalize()} {no}", f"{no} {name}"], [44, 16, 10, 23, 5, 2])[0]
        if r.random() < 0.03:
            line = line.lower()
        town = self.stem(r.choice([1, 2])).capitalize() + r.choice(["", "burg", "ville", "ton", "stad", "by", "dorf", "ford"])
        before = r.choices(["", f"{r.choice(['Flat', 'Apt.', 'Unit', 'Apartment'])} {r.randint(1, 40)}, "], [78, 22])[0]
        return before, line, r.choice(["", "", f", {town}", f", {self.digits(5)} {town}", f" in {town}", f", {town} {self.digits(4)}"])

    # --- sentences ---

    def look_alike(self) -> str:
        r, d, w = self.r, self.digits, self.word
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 12, 16, 32])))
        return r.choice([
            f"{r.choice(['part', 'Part No.', 'part number', 'P/N', 'item no.', 'article', 'Art. no.', 'model', 'serial no.', 'spare part', 'catalogue no.'])} {d(3)}-{d(r.choice([4, 5, 6]))}-{r.choice('ABCDEFGHKLMX')}", f"{r.choice(['part no.', 'item', 'stock', 'product code', 'lot'])} {d(r.choice([2, 3, 4]))}-{d(r.choice([4, 6, 7]))} {r.choice(['is sold out', 'was reordered', 'in stock', ''])}", f"SKU {d(4)}-{d(4)}", f"build {r.randint(2015, 2026)}{r.randint(1, 12):02}{r.randint(1, 28):02}-{d(4)}", f"session {d(16)}", f"sha {hexa}", f"offset {d(10)}", f"order {d(8)} shipped", f"ref. {w()}-{d(3)}-{d(2)}-{d(4)}",
            f"{r.choice(['host', 'node', 'address', 'on', 'gateway'])} {r.choice([10, 172, 192, 198, 203])}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}", f"took {d(2)}.{d(4)} ms", f"{r.randint(1, 9)}.{r.randint(0, 40)}.{d(3)}-{d(4)}", f"at {d(2)}:{d(2)}:{d(2)}.{d(3)}", f"{r.randint(1990, 2026)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{d(2)}:{d(2)}:{d(2)}Z",
            f"ping @{w()} there", f"@lru_cache(maxsize={d(3)})", f"ISBN {r.choice(['', 'is ', 'no. '])}978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"ticket {r.choice(['ORD', 'INC', 'BUG'])}-{d(3)}-{d(2)}-{d(4)}", f'"id": "{d(8)}"', f"price {d(3)}.{d(2)} / {d(4)}", f"{d(3)} rows, {d(4)} bytes", f"run at {w()} with {d(2)} avenues", f"look at {w()}.{w()} dot product",
            f"{self.a_given()} said so", f"the {self.a_family()} theorem", f"{self.a_given()} thinks twice", f"a {self.a_family()} filter on {w()}", f"{r.randint(1, 31)} {r.choice(['March', 'June', 'August', 'May'])} {d(4)}", f"phase {d(1)} {w()} {d(2)}", f"meet at noon, not at {w()}", f"v{d(1)}.{d(2)} {w()} {d(3)}", f"lot {d(9)}", f"batch no. {d(10)} / {d(6)}",
        ])

    def plain(self) -> str:
        r = self.r
        if self.background and r.random() < 0.75:
            text = r.choice(self.background)
            a = r.randrange(max(1, len(text) - 60))
            a = max(0, text.find(" ", a))
            return text[a : a + r.randint(30, 150)].strip() or "none"
        made = r.choice(_PLAIN)
        for slot, fill in (("{w}", self.word), ("{v}", self.word), ("{W}", lambda: self.word().capitalize()), ("{n}", lambda: str(r.randint(0, 9999)))):
            while slot in made:
                made = made.replace(slot, fill(), 1)
        return made

    def worn(self, text: str) -> str:
        """A text without items, sometimes with words in capitals, a foreign word or a look-alike in it."""
        r, words = self.r, text.split(" ")
        at = r.randrange(len(words) + 1)
        roll = r.random()
        if roll < 0.1:
            words[at : at + r.randint(1, 6)] = [w.upper() for w in words[at : at + r.randint(1, 6)]]
        elif roll < 0.2:
            words.insert(at, self.word())
        elif roll < 0.3:
            words.insert(at, self.look_alike())
        elif roll < 0.33:
            words[at : at + 4] = [w.capitalize() for w in words[at : at + 4]]
        return " ".join(words)

    def item(self, name: str) -> tuple[str, str, str]:
        before, x, after = self.address() if name == "address" else ("", getattr(self, name)(), "")
        if name in ("phone", "national_id") and self.r.random() < 0.05:
            x = x.replace(" ", " ")
        return before, x, after

    def sentence(self) -> tuple[str, list[tuple[int, int, int]]]:
        r = self.r
        roll = r.random()
        if roll < 0.12:
            return self.worn(self.look_alike()), []
        if roll < 0.42:
            return self.worn(self.plain()), []
        kind = r.choices(range(len(TYPES)), [20, 19, 18, 19, 24])[0]
        name = TYPES[kind]
        before, x, after = self.item(name)
        way = r.random()
        if way < 0.48:
            frame = r.choice(self.frames[name])
            if name == "person_name" and r.random() < 0.08 and re.search(r"name|user|attn|customer|client|patient", frame.lower()):
                x = x.lower()
            head, tail = frame.split("{x}")
            if head and r.random() < 0.4:
                head = head[0].upper() + head[1:]
            tail += r.choice(["", "", ".", "!", ","]) if not tail else ""
            if r.random() < 0.3:
                tail += " " + self.plain()
        elif way < 0.63:  # a key and its value
            head, tail = r.choice(kept(_KEYS[name], self.held)) + r.choice([": ", "=", " = ", ": \"", " -> ", " | "]), r.choice(["", ";", "\"", " |", ","])
            if name == "person_name" and r.random() < 0.08:
                x = x.lower()
        elif way < 0.7:
            head, tail = r.choice(["", "(", "- ", "* ", "> "]), r.choice(["", ")", ".", " -"])
        else:  # bare, between the words of a text without items
            words = self.plain().split(" ")
            at = r.randrange(len(words) + 1)
            head, tail = " ".join([*words[:at], ""]), " ".join(["", *words[at:]])
            if r.random() < 0.25:
                tail = r.choice([",", ":", ";", "."]) + tail
            elif r.random() < 0.15:
                head, tail = head + "(", ")" + tail
        head, tail = head + before, after + tail
        return head + x + tail, [(len(head), len(head) + len(x), kind)]

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        text, spans = "", []
        for _ in range(self.r.choice([1, 1, 2, 3])):
            s, found = self.sentence()
            spans += [(a + len(text), z + len(text), k) for a, z, k in found]
            text += s + self.r.choice([" ", " ", ". ", "  ", "\n", "; ", "\t"])
        if self.r.random() < 0.02:
            text = text.lower()
        return text.rstrip() if self.r.random() < 0.3 else text, spans


def windows(maker: Maker, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, labels) of windows cut at random from made texts."""
    codes, labels = np.zeros((count, TRAINED), np.uint8), np.zeros((count, TRAINED), np.int64)
    n = 0
    while n < count:
        text, spans = maker.text()
        c = char_codes(text)
        y = np.zeros(len(c), np.int64)
        for a, z, k in spans:
            y[a], y[a + 1 : z] = 1 + 2 * k, 2 + 2 * k
        for s in {0, max(0, maker.r.randint(0, max(0, len(c) - 40)))}:
            part, want = c[s : s + TRAINED], y[s : s + TRAINED].copy()
            if len(want) and want[0] and want[0] % 2 == 0:
                want[0] -= 1
            if n < count and len(part):
                codes[n, : len(part)], labels[n, : len(part)] = part, want
                n += 1
    return codes, labels
