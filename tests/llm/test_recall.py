"""Recall and precision of operator 6 by kind, on labelled texts whose names stand in none of its lists."""

import re
from collections import Counter

from lodestream.llm import names, pii
from tests.llm.test_private import OWN

#: Texts, with {kind|entity} for each entity.
LABELLED = """
Our driver {person|Obinna} {person|Chukwuma} will be waiting at the gate.
The report was prepared by {person|Hiroko} {person|Fujimoto} and checked twice.
{person|Ludmila} {person|Zelenkova} said that the roof leaks.
I spoke with {person|Parvati} {person|Subramanian} on the phone this morning.
My name is {person|Efua} {person|Asante} and I would like a refund.
Dear {person|Bartholomew} {person|Finch},
Regards,\\n{person|Ottavia} {person|Marchetti}
please forward it to {person|Yevgeny} {person|Baranov} today
Thanks to {person|Shanice} {person|Goodwin} for the photographs.
The nurse {person|Wiremu} {person|Parata} took the sample.
According to {person|Nasrin} {person|Sohrabi}, the train was late.
{person|Ebenezer} {person|Thornbury}, who lives upstairs, complained.
selon {person|Thibault} {person|Carpentier}, le pont est fermé
mein Name ist {person|Gerlinde} {person|Pfeiffer} und ich wohne hier
me llamo {person|Anselmo} {person|Villanueva} y trabajo aquí
written by {person|Sunniva} {person|Haugen} in the spring
She married {person|Tobiasz} {person|Malinowski} in Poland.
Please call {person|Delphine} {person|Vasseur} tomorrow.
{person|Kamal} {person|Bhattarai} told us the way.
contact {person|Rosalind} {person|Achterberg} at the desk
The tenant {person|Chinedu} {person|Eke} paid in cash.
a note from {person|Xochitl} {person|Ramos} was found
Name: {person|Fredrik} {person|Lindqvist}
{person|Aroha} {person|Ngata}'s dog barks at night.
employee {person|Dalibor} {person|Hrubý} asked for leave
The witness, {person|Imogen} {person|Sackville}, left early.
sent to {person|Tiago} {person|Figueira} last week
{person|Mikael} {person|Strand} and {person|Petra} {person|Ojala} went home.
Dr {person|Venkatesan} and Mrs {person|Oyelaran} were there.
Frau {person|Rosenkranz} und Herr {person|Zöllner} kamen.
Наталья {person|}
Call {phone|020 7123 4567} or {phone|0161 496 0123}.
Tel: {phone|01 45 67 89 10}, fax {phone|0345 6789012}
ring me at {phone|5559876543} please
mobile: {phone|07700 900123}
phone {phone|+44 20 7946 0000} ext 3
Telefon: {phone|030/1234567}
my phone number is {phone|(212) 555-0147}
llama al móvil {phone|612 345 678}
portable: {phone|06 12 34 56 78}
her mail is {email|anne.q@post.example.org} now
write to {email|info+sales@sub.firma.de}.
{email|Ünal.Öz@türk.com.tr} answered
paid with {card|4539 1488 0343 6467} online
card number {card|4556737586899855}
amex {card|3714 496353 98431} please
server {ip|10.44.3.17} and {ip|2001:db8:1::9} are down
ssn {ssn|078-05-1120}
IBAN {iban|GB29 NWBK 6016 1331 9268 19}
the password is {secret|Tr0ub4dor}
password: {secret|correcthorse}
api_key = "{secret|a8F3kk29dkQ01x}"
export TOKEN={secret|zzYY88xx77WW66}
bearer eyJ{secret|hbGciOiJub25lIn0.eyJpc3MiOiJqb2UifQ.c2lnbmF0dXJlLWhlcmU}
aws AKIA{secret|IOSFODNN7EXAMPLE}
contraseña es {secret|perro#2024}
passport no. {document|P4872210}
Reisepass: {document|C01X00T47}
driver's license {document|D1234567}
born on {birthdate|1979-11-02} in a village
date of birth: {birthdate|07/09/1991}
geboren am {birthdate|3.4.1966}
She lives at {address|14 Wexford Road} now.
deliver to {address|1600 Old Mill Lane} please
habite {address|27 rue du Château}
vive en {address|Calle Alcalá 45}
wohnt {address|Lindenallee 7}
We went to Niagara Falls and Heathrow Airport.
The World Bank and the European Commission agreed.
How to Set Up the printer
See Terms And Conditions for more.
Hong Kong and New Delhi are far.
the Bay of Bengal and Cape Town
Cambridge University Press published it.
Read Our Latest News
released under the Apache License, version 2.0.1.5
build 10.0.19041.1 was installed
created_at 1712345678901 and id 9007199254740993
order 100200300400500 was shipped
In 2019 2020 2021 2022 sales rose.
the password is required and the token is invalid
on 2024-05-06 at 12:30 the release was cut
call 911 in an emergency
he ran 100 200 300 metres
section 3.4.1.2 of the manual
Black Forest cake and Swiss Cheese
Monday Night was quiet
The Lord Mayor spoke at Guildhall Square
a street of 20 houses, and a road
passport control was slow
Silicon Valley and Wall Street
The North Sea is cold.
Add New User
Table Of Contents
Mark Down the prices
Grant Park is in Chicago
""".strip().replace("Наталья {person|}\n", "")


def labelled():
    """Text and entities (start, kind, original)."""
    for line in LABELLED.replace("\\n", "\n\t").replace("\n\t", "\x00").split("\n"):
        text, there = "", set()
        for i, part in enumerate(line.replace("\x00", "\n").replace("}", "{").split("{")):
            if i % 2:
                kind, part = part.split("|")
                there.add((len(text), kind, part))
            text += part
        yield text, there


def measured():
    """Of each kind how many are there, found, and found where there are none."""
    there, right, wrong = Counter(), Counter(), Counter()
    for text, expected in labelled():
        got = {(a, kind, text[a:b]) for a, b, kind, _ in pii.entities(text, OWN)}
        there.update(kind for _, kind, _ in expected)
        right.update(kind for _, kind, _ in got & expected)
        wrong.update(kind for _, kind, _ in got - expected)
    return there, right, wrong


def test_recall_and_precision():
    there, right, wrong = measured()
    assert there["person"] >= 60 and sum(there.values()) >= 100
    for kind in there:
        assert right[kind] >= 0.85 * there[kind], (kind, there[kind], right[kind])
        assert wrong[kind] <= 0.12 * max(10, right[kind]), (kind, wrong[kind])
    assert sum(right.values()) >= 0.93 * sum(there.values()) and sum(wrong.values()) <= 8


def test_names_are_in_no_list():
    known = {*names.GIVEN, *names.FAMILY, *pii._FOLDED}
    people = {word.lower() for _, expected in labelled() for _, kind, word in expected if kind == "person"}
    assert len(people - known) >= 0.95 * len(people)


def test_no_last_resort_for_these():
    """What is found keeps its format: the keyed digits that stand in for what has no way back aren't reached."""
    for text, _ in labelled():
        for *_, new in pii.entities(text, OWN):
            assert not re.fullmatch("[0-9a-f]{32}(@.*)?", new)


GENDERED = {"Анна Иванова и Пётр Смирнов": ("ова", "ов"), "Jana Nováková said": ("ová",), "Agnieszka Zielinska lives": ("ska",)}


def test_endings_of_family_names_stay():
    for text, ends in GENDERED.items():
        new = [n for _, _, kind, n in pii.entities(text, OWN) if kind == "person"]
        assert [n[-len(e) :] for n, e in zip(new[1::2], ends, strict=True)] == list(ends)
    family = [a + b + e for a in ("ник", "вол", "бел") for b in "аеи" for e in ("лова", "лов", "ский", "ская", "лин", "лина", "лак")]
    made = [OWN.family(n, pii._FOLDED) for n in family]
    assert len(set(made)) == len(family) and [OWN.inverse.family(n, pii._FOLDED) for n in made] == family


def test_many_names_without_capitals_take_linear_time():
    import time

    family = [chr(0x0621 + i % 20) + chr(0x0627 + i // 20 % 20) + chr(0x062A + i // 400) for i in range(4000)]
    text = " ".join(f"السيد {n} قال" for n in family)
    begin = time.process_time()
    pii.entities(text, OWN)
    first = time.process_time() - begin
    begin = time.process_time()
    pii.entities(text + " " + text, OWN)
    assert time.process_time() - begin < 4 * first + 1
