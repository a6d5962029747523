"""The labelled table from which the field is trained: a line of text each, with marked spans as [kind:text]."""

from __future__ import annotations

import re

# Lines written for this purpose, in four languages, about invented people.
LINES = """
My name is [name:Anna Weber] and I live at [street:12 Maple Street], near the old mill.
Dear Mr. [name:Thomas Reed], thank you for your letter of the second week.
Please contact Mrs. [name:Helen Carter] or Dr. [name:Ibrahim Khan] for the results.
Patient: [name:Maria Lopez], born on [birth:12/03/1985], was seen on Monday.
Sincerely, [name:John Miller]
Kind regards, [name:Sofia Rossi]
Name: [name:Peter O'Brien]
Name: [name:Li Wei] Address: [street:7 High Road]
Employee [name:Grace Hopper Lane] joined the team in March 2019.
His social security number is [id:123-45-6789] and should not be here.
SSN: [id:987-65-4321]
Social security number [id:321-54-9876] was sent by mistake.
Date of birth: [birth:1979-11-30]
DOB: [birth:04/17/1990]
She was born on [birth:3 June 1964] in a small town by the sea.
born [birth:21.08.1955], died in the same house
Passport number [id:X1234567] expires next year.
Passport no. [id:C01X00T47] was lost on the train.
IBAN: [id:DE89 3704 0044 0532 0130 00]
Please pay to IBAN [id:GB29 NWBK 6016 1331 9268 19] before Friday.
The parcel went to [street:221 Baker Street] on a rainy afternoon.
Address: [street:45 Old Oak Avenue]
We moved from [street:9 Rosewood Lane] to [street:1840 West Hill Drive] last summer.
Mr. [name:Okafor] and Ms. [name:Lindqvist] signed the contract.
I spoke with Dr. [name:Elena Petrova] about it.
Signed by Mr. [name:Andrew Stone], director of the company.
Tax number: [id:12-3456789]
Driver licence number [id:D400 7836 0001] was checked.
Ihr Name ist [name:Petra Schneider] und sie wohnt in der [street:Lindenstraße 14].
Sehr geehrter Herr [name:Klaus Baumann], vielen Dank für Ihren Brief.
Sehr geehrte Frau [name:Ingrid Vogel], wir freuen uns sehr.
Mit freundlichen Grüßen, [name:Jonas Becker]
Herr [name:Dieter Wolf] und Frau [name:Sabine Koch] kommen am Montag.
Name: [name:Uwe Krause], geboren am [birth:14.02.1971] in Hamburg
Geburtsdatum: [birth:30.09.1948]
geboren am [birth:5. Mai 1982]
Adresse: [street:Hauptstraße 5]
Wir treffen uns in der [street:Bergstraße 112] um acht Uhr.
Er wohnt am [street:Gartenweg 3] mit seinem Hund.
Steuernummer: [id:21/815/08150]
Personalausweis Nr. [id:L01X00T471] ist abgelaufen.
IBAN: [id:AT61 1904 3002 3457 3201]
Je m'appelle [name:Claire Dubois] et j'habite au [street:18 rue des Lilas].
Monsieur [name:Henri Moreau] habite [street:4 avenue de la Gare] depuis dix ans.
Madame [name:Lucie Bernard] est venue hier.
Cordialement, [name:Paul Girard]
Mme [name:Jeanne Petit] et M. [name:Marc Fontaine] ont signé.
Nom : [name:Camille Laurent], née le [birth:22/07/1993] à Lyon
né le [birth:9 janvier 1958]
Date de naissance : [birth:01/12/1969]
Adresse : [street:33 boulevard Victor]
Numéro de sécurité sociale : [id:2 85 05 78 006 084]
Passeport numéro [id:12AB34567] perdu dans le train.
IBAN : [id:FR76 3000 6000 0112 3456 7890 189]
Me llamo [name:Carlos Ruiz] y vivo en la [street:calle Mayor 22] con mi hermana.
Estimada señora [name:Lucía Torres], gracias por su carta.
El señor [name:Miguel Ángel Vega] llegó tarde.
Sra. [name:Rosa Jiménez] y Sr. [name:Pablo Núñez] firmaron ayer.
Atentamente, [name:Elena Castro]
Nombre: [name:Diego Herrera], nacido el [birth:17/10/1988] en Toledo
Fecha de nacimiento: [birth:25/06/1975]
nacida el [birth:2 de abril de 1961]
Dirección: [street:calle del Sol 8]
Vive en la [street:avenida del Puerto 101] desde marzo.
DNI: [id:12345678Z]
DNI [id:87654321X] del cliente.
Número de pasaporte [id:XDA123456] caducado.
The red house by the river was built in 1905 and sold twice.
Monday was cold. Tuesday was worse, and the roads were closed.
In 1999 the company sold 12,500 units at 3.50 each.
The meeting on 12/03/2020 was moved to room 14 on the second floor.
Order 4711 shipped on 2021-05-06 with 3 boxes.
See page 12, chapter 4, and the table below for details.
Red River Valley and Green Hill are places on the map.
The New Garden Hotel opened its doors last Summer.
Version 2.10.3 fixes the error in line 88 of the file.
He said: I do not know. She said: Neither do I.
Name of the product: the little lamp
The name of the game is patience, and the address of the site is unknown.
Street lights were on; the avenue was empty, and no road led home.
The patient waited. Doctors and nurses came and went all day.
Call the office between 9 and 17 or write a letter.
Copyright 2015. All rights reserved. Licensed under the terms below.
Thonble edrea wasting ther, onstwh eden. Reoran thedhe tion hershing of the rethed.
Onst ingther 42 thanaed. Eredon ble wh, Anathe ou: rething stion.
Re thare Onthed Ering was Thond. Stble Innand heon, the Reaou.
Edenthe 1290 ering 77 ontion. Thhewh 5 eden!
Der rote Wagen stand im Hof. Die Kinder spielten am Abend im Garten.
Im Jahr 1987 wurden 350 Häuser in der Stadt gebaut.
Die Straße war leer und der Weg nach Hause lang.
Am Montag fährt der Zug um 8 Uhr nach Berlin. Herren und Frauen warten.
Chteü sich Bebelich. Ergezu eniebe auf, Entzau ersttz enst auer chi. Schung der Keit.
Erung Heitge Lich und die Stber Enge, ein Pföch. Zukeit 12 eren.
La maison rouge était vide. Le jardin aussi, depuis 1998.
Le nom de la rose est un livre de 500 pages.
La rue était calme et le boulevard aussi.
Les enfants jouent. Monsieur le maire parle. Madame est servie.
Tionre auxment lles. Eauque pas de Pavi queçê, Ouoian éeaueaule.
El coche rojo estaba en la calle. En 2004 vendieron 20 casas.
El nombre de la obra es muy largo y la calle muy corta.
La señora habló con el señor del mercado.
Ciónesdo lados. Ñgacoí mente, Esrr ciónjall 77 uedoar.
Total: 1,250.00 Date: 03/04/2021 Number: 5521
Invoice number 2020-117 of 14 May 2020 is paid.
Account 17 was closed; number 9 stays open.
Sincerely yours and with regards to all of them.
Dear all, dear friends, dear reader, thank you for coming.
Mr. and Mrs. were titles they never used.
Regards from the whole team at the North Office.
Licensed under the GNU General Public License, version 2 or later.
This file is part of the Apache Software Foundation and the Public License applies.
an. an. an. an. Thsterhe Thsterhe Thsterhe hetiwh hetiwh.
Sich Sich Sich Sich Sich
Orre Orre Orre Orre orantion the Orre
la ê leelle. Enque épaoi et de. Treau la ont.
Pa. Équeaion ééeux la. Eçan, ve. Ousque.
el. Ciónboie óez. Taque esquees y de. Mente la ya.
th. Onst he. An in. Heor, re. Thond of. Sher.
| Eaion | thinly | Tioningst | Rerr. | Adoas |
en. Zuöpf auf. Ensch Ungau, ein. Keitau der. Bech.
Reoié Reoié. Çaux, Élere, Èeux. Leau Onou Onou Onou
Dear Mrs. [name:Hughes], the keys are with the neighbour.
Dear Ms. [name:Alice Grant], dear Mr. [name:Cole], we thank you.
Señora [name:Marta Ibarra], gracias por todo.
Señor [name:Luis Peña] vive aquí.
Frau [name:Lang] und Herr [name:Otto Brandt] wohnen dort.
""".strip().splitlines()

_MARK = re.compile(r"\[([a-z]+):([^\]]*)\]")


def examples() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Text and spans (start, end, kind) of each line."""
    out = []
    for line in LINES:
        text, spans, at = "", [], 0
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out
