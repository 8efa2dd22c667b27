"""The labelled table of the personal-information model: a small grammar of everyday texts with marked values.

The sentences are general correspondence, forms, chats, logs, slips and lists in five languages; none is taken from a
corpus. ``(a|b)`` is a choice, ``{name}``, ``{email}``, ``{phone}``, ``{id}`` and ``{addr..}`` are marked values, other
holes are plain. Context words are partly invented, so that the model has to learn shapes and announcing words. How
many rows are made is a parameter (`ROWS`), the same for every size of corpus. Patterns have a number; ``labelled_rows``
can be told to use only some of them, which leaves the others for a test on patterns never seen.
"""

from __future__ import annotations

import random
import re

ROWS = 16000

GIVEN = (
    "Aaron Abigail Adrian Ahmed Aisha Albin Alma Amara Andre Angela Anika Anke Antoine April Arjun Arthur Aurora Axel Barbara Bastian Ben Bernd Birgit Boris Brenda Brian Bridget Caleb Camille Carlos Caroline Catherine Celia Chen "
    "Chloe Christoph Clemens Colin Cora Craig Cynthia Damian Dana Daniel Darla Deborah Dennis Dirk Dolores Donald Dora Douglas Edgar Edward Eileen Eleanor Emilia Enrique Erica Ernst Estelle Ethan Eugene Fatima Fernando Florence "
    "Francis Gabriel Gerard Gina Gordon Grace Graham Gustav Hamid Harriet Heather Hector Hiroshi Holly Hubert Imran Isabel Jack James Janet Jasmine Javier Jean Jeremy Jesse Joachim Jordan Joyce Juan Judith Kai Kamal Kenneth Kevin "
    "Kirsten Klaus Lara Lena Liam Linda Lorenzo Lucas Luis Lydia Magnus Manuel Marcel Margaret Marie Mark Martin Matthew Megan Michael Miguel Mila Mohamed Monica Nathan Neil Nicole Nikolai Noah Olivia Omar Oscar Pamela Patrick Peter "
    "Philip Pia Rachel Ralph Ravi Rebecca Rene Ricardo Robert Roland Ruth Ryan Samuel Sandra Sebastian Sergio Sheila Silvia Sophie Steven Susan Sylvie Tanja Thomas Tim Timo Ulrich Valerie Victor Walter Wendy Yolanda"
).split()
FAMILY = (
    "Adams Ali Allen Anderson Bailey Baker Bauer Becker Bell Bennett Berger Bianchi Blanc Bonnet Brown Campbell Carter Castillo Clark Collins Cook Cooper Costa Cox Cruz Davies Davis Diaz Dubois Dupont Edwards Evans Fernandez Fischer Foster Fournier Garcia Gomez Gonzalez Gray Green Hall Harris Hernandez Hill Hoffmann Hughes "
    "Jackson Jansen Jansson Johnson Jones Kaya Keller Kelly Khan Kim King Klein Kowalski Krause Kumar Lambert Lee Lefebvre Lewis Lopez Martinez Meyer Miller Moore Moreau Moreno Morgan Morris Müller Murphy Nelson Neumann Nguyen Novak Ortiz Parker Patel Perez Peters Phillips Popescu Richter Rivera Roberts Robinson Rodriguez Romano Rossi Russo Sanchez "
    "Schmidt Schneider Scott Silva Simon Singh Smit Smith Stewart Suzuki Svensson Taylor Thompson Torres Turner Visser Wagner Walker Wang Ward Watson Weber White Williams Wilson Wolf Wood Wright Young Yilmaz Zimmermann"
).split()
LEGAL = ("Ltd", "Ltd.", "LLC", "GmbH", "B.V.", "S.A.", "S.L.", "SARL", "Inc.", "& Co.", "PLC", "AG", "KG", "& Sons", "N.V.", "", "", "")
TRADES = "Foods Tools Freight Textiles Supplies Systems Motors Catering Logistics Bakery Pharmacy Hardware Services Electric Garden Books Travel Media Energy Dairy Plumbing Bikes Optics Partners Holdings Market Store Group Trading Furniture Paper Metals Glass Cleaning".split()
WORDS = (
    "account answer apple archive bag banana battery bed bell bicycle blanket board bolt book bottle bowl box branch bread brick bridge brush bucket budget button cabinet card carpet chair change charge cheese circuit claim clock cloth coat coffee corner cost crate cup "
    "curtain cushion day delivery desk detail dish door dress drill egg engine entry error fan file filter fish floor flour folder form frame fruit fuel garden glass glove guide hammer handle hat heater hook hose house ink iron item jacket jar juice key keyboard knife ladder lamp "
    "leather letter lid light lock machine map mark meat meeting message meter milk mirror month motor nail name net note number office oil order oven packet paint pan paper parcel part pepper phone picture pipe plan plate policy pot pump question rack rail record rent report "
    "request rice ring roof room rope rule salt sample sauce scale school screen screw seat section seed sheet shelf shirt shoe shop shovel sign soup spoon spring stamp station step stone story sugar sum switch system table tape tea team test ticket tile tin tool tooth town train tray "
    "tube unit value version view wall wallet watch water week wheel window wire wood wool work yard year"
).split()
ADJ = "big black blue broken brown clean closed cold cotton dark dry early empty extra fine flat fresh front full green grey half heavy high hot large late left light long low narrow new next noisy old open orange organic paid pale plain quick red right round sharp short simple single slow small soft spare steel strong thin upper used warm white wide wooden yellow".split()
VERBS = "adds asks breaks brings calls carries changes closes comes costs covers cuts drops ends explains falls finds follows gets gives goes grows has holds keeps leaves lists looks makes matches means moves needs opens pays prints puts reads remains runs says sells sends sets shows starts stays stops takes tells turns uses wants works writes".split()
PREPS = "about above across after against along among around at before behind below beside between by down during for from in inside into near of off on onto out over past since through to toward under until up with within without".split()
FOREIGN = (
    "der die das und ist nicht mit auf für eine vom zur noch wird sind bei nach aber oder wenn le la les des une est pas avec pour dans sur par plus cette sont qui que mais el los las una con por para del como pero esta son sin más het een van voor niet aan dat deze naar zijn wordt bij uit ook"
).split()
CODE_WORDS = "order,order no.,purchase order,batch,lot,article,item,item code,SKU,part no.,product code,serial no.,model,tracking,parcel,shipment,consignment,ticket,case,reference,ref.,our ref,invoice,invoice no.,receipt,voucher,coupon,booking,quote,contract,policy,meter,barcode,customer no.,account,supplier,terminal,register,till,store,version,revision,document,page,room,flight,approval,transaction,Auftrag,Bestellung,Charge,Artikel,Rechnung,Kundennummer,Lieferschein,commande,lot n°,article n°,facture,référence,pedido,lote,artículo,factura,referencia,bestelling,partij,artikel,factuur,klantnummer".split(",")
ID_WORDS = (
    "passport,passport no.,passport number,passport #,travel document,SSN,SSN:,social security number,social security no.,Social Security #,soc. sec. no.,national ID,national ID no.,national identity number,identity card,identity card no.,ID card,ID no.,ID number,identification number,personal number,personal ID,tax ID,TIN,taxpayer number,"
    "national insurance number,national insurance no.,NI no.,NINO,driver's license,driver licence no.,driving licence,residence permit,residence permit no.,health insurance no.,citizen number,birth number,"
    "Reisepass,Reisepassnummer,Pass-Nr.,Ausweisnummer,Personalausweis Nr.,Ausweis,Steuer-ID,Steueridentifikationsnummer,Sozialversicherungsnummer,SV-Nummer,AHV-Nr.,Führerschein Nr.,"
    "passeport,passeport no,numéro de passeport,carte d'identité,carte d'identité no,CNI,numéro de sécurité sociale,n° de sécurité sociale,NIR,titre de séjour,permis de conduire,"
    "pasaporte,pasaporte n.º,número de pasaporte,DNI,D.N.I.,NIE,NIF,documento de identidad,n.º de la Seguridad Social,carné de conducir,"
    "paspoort,paspoortnummer,BSN,burgerservicenummer,identiteitskaart,identiteitsbewijs,rijbewijs,rijksregisternummer"
).split(",")

PATTERNS = """
(Best|Warm|Many thanks and kind|With kind|Sincerely,|Yours truly,|Cheers,|Thanks,) (regards,|)\\n{name}
(Greetings|All the best|Speak soon|Yours),\\n{name}\\n{firm}
(Mit freundlichen Grüßen|Viele Grüße|Herzliche Grüße|Hochachtungsvoll),?\\n{name}
(Cordialement|Bien à vous|Sincères salutations|Meilleures salutations),\\n{name}
(Un saludo|Saludos cordiales|Atentamente),\\n{name}
(Met vriendelijke groet|Hartelijke groeten|Hoogachtend),\\n{name}
(Dear|Hi|Hey|Good morning|Hello again) (Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Miss|Dr|Dr.|Prof.|) {name}(,|!|:)
(Dear|Hi|Hello|Hey|Good evening) {name}(,|!|:)
(Dear|Hello) {name},\n{w} {w} {verb} the {w}.
(Lieber|Liebe|Guten Tag|Hallo|Sehr geehrter|Sehr geehrter Herr|Guten Tag Frau) {name},
(Cher|Chère|Bonsoir|Chère Madame|Cher Monsieur) {name},
(Estimado|Estimada|Hola|Buenos días|Estimado Sr.|Estimada Sra.) {name}:
(Beste|Geachte|Goedemorgen|Geachte mevrouw|Beste heer) {name},
(Employee|Patient|Passenger|Guest|Tenant|Student|Applicant|Owner|Driver|Host|Author|Editor|Payee|Holder|Witness|Nurse|Teacher|Waiter|Clerk|Operator|Agent|Salesperson|Your server|Your host|Your cashier|Technician|Inspector)(:| :|) {name}
(Full name|Name|Contact|Contact name|Person|Recipient|Sender|Account holder|Name on card|Next of kin|Emergency contact|Buyer|Requested by|Approved by|Reviewed by|Received by|Issued by|Delivered by|Written by|Entered by|Signed by|Packed by|Sold by|Handled by|Scanned by|Verified by|Reported by|c/o|FAO|For the attention of)(:| -|) {name}
(Mitarbeiter|Ansprechpartner|Sachbearbeiter|Kassierer|Verkäufer|Name|Bearbeiter|Unterschrift|Fahrer|Empfangen von|Freigegeben von|Sie wurden bedient von|z. Hd.)(:|) {name}
(Nom|Interlocuteur|Vendeur|Signataire|Rédigé par|Reçu par|Approuvé par|Vous avez été servi par|Caissier|À l'attention de)( :|) {name}
(Nombre|Contacto|Vendedor|Firmado por|Recibido por|Aprobado por|Le ha atendido|Cajero|A la atención de)(:|) {name}
(Naam|Contactpersoon|Verkoper|Getekend door|Ontvangen door|Goedgekeurd door|Kassier|Ter attentie van|T.a.v.)(:|) {name}
(Mr|Mr.|Mrs|Mrs.|Ms|Ms.|Dr|Dr.) {name} (said|writes|wrote|called|came|asks|claims|thinks|replied|paid|complained|signed|refused|wants) (that|because|when|for|about|to|) (the|a|this|that) {w} {verb} {w}.
{name} (said|writes|wrote|called|came|asked|claims|thinks|replied|paid|complained|signed|refused|agreed|confirmed|noted|reported) (that|because|when|for|about|to|) (the|a|this|that) {adj} {w} {prep} the {w}.
{name} (is|was|will be|has been) (away|here|late|right|promoted|on leave|our new manager|the tenant) (today|since May|until Friday|this week|).
(We|They|I) (met|asked|told|thanked|saw|paid|called|informed|phoned) {name} (yesterday|on Tuesday|last week|at noon|twice|) (about|near|before|at) the {w}.
(The|A|This) {adj} {w} (belongs to|was signed by|was checked by|was made by|came from|is for|was left with|was sent by|was corrected by|was brought by|was taken by|was copied by) {name}( at {h}| on {date}| and {name}| in person|)(.|)
(Spoke|Talked|Meeting|Call|Lunch|Interview) with {name} (on {date}|at {h}|about the {w}|)(.|)
(Minutes taken by|Attendees:|Present:|Participants:) {name}, {name} and {name}.
(Please|Kindly|Could you) (ask|remind|tell|phone|contact|inform) {name} (about|before|regarding|of) the {w}.
{name} / {firm}
{name}, {firm}, {date}
Hotel guest {name}, room {d3}, (arrives|leaves) {date}
(Laut|Nach Auskunft von|Wie uns) {name} {f} {f} {x} {f} {x}.
(Herr|Frau|Hr.|Fr.|Herrn) {name} {f} {x} {f} {f} {x}.
(M.|Mme|Monsieur|Madame|Mlle) {name} {f} {x} {f} {f} {x}.
(Sr.|Sra.|El señor|La señora|Don|Doña|El Sr.|La Sra.) {name} {f} {x} {f} {f} {x}.
(Dhr.|Mevr.|De heer|Mevrouw|Mw.) {name} {f} {x} {f} {f} {x}.
{f} {x} {f} (von|bei|mit|durch) {name} {f} {x}.
{f} {x} {f} (par|avec|chez|pour) {name} {f} {x}.
{f} {x} {f} (por|con|para) {name} {f} {x}.
{f} {x} {f} (door|met|voor) {name} {f} {x}.
(Mail|My mail|New address|Login|User|User name|Account|Newsletter|Support|Sales|Web contact|Cc|Bcc|From|To|Reply-To|Sender|Kontakt|Adresse e-mail|Mél|Correo electrónico|E-mailadres|Elektronische Post)(:| :| -|) {email}
(From|To|Cc): {name} <{email}>
(Please|Kindly) (send|mail|forward|return|copy|address) (it|them|this|the {w}|all {w}s) to {email}( today| by {date}| as soon as possible|)(.|)
(I|We|You) can be reached (under|at|via) {email}( or {phone}|)( any time|)(.|)
(The|A) {w} (came|arrived|bounced|was sent|was received) from {email}( on {date}| at {h}|)(.|)
{email} (asked|wrote|replied|complained|bounced|signed up|has no access) (about|to|for|on|) the {w}.
(Any|Further|More) (questions|remarks|details)? (Ask|Mail|Contact|Reach) {email}(!|.|)
{f} {x} {f} {email} {f} {x}.
({x}|Nachricht|Message|Mensaje|Bericht) (an|à|a|naar|von|de|van) {email}(.|)
{email}
{firm} | {email} | {phone}
(Telephone|Phone number|Phone no.|Cell|Cell phone|Mobile|Mobile no.|Home|Work|Office|Direct line|Direct|Desk|Hotline|Helpdesk|Switchboard|Reception|Fax no.|Telefax|WhatsApp|Contact no.|T|P|M|F|Ph|Ph.|Handy|Mobil|Telefonnummer|Rufnummer|Zentrale|Téléphone|Portable|Télécopie|Numéro|Móvil|Teléfono fijo|Tfno.|Mobiel|Telefoonnummer|Vast nummer)(:| :|) {phone}
(Please|Just|Do|You may) (call|ring|phone|text|try|dial) (us|me|them|him|her|the office|) (on|at|under|back on|) {phone}( before {h}| after {h}| tomorrow| any day|)(.|)
(He|She|The caller|My sister|The guest|Our agent|A neighbour) (called|rang|texted|can be reached|left a message) (from|on|at|under) {phone}( at {h}| on {date}| yesterday|)(.|)
(Call back number|Number for the courier|Emergency number|New number|Tel/Fax) {phone}
(Anruf|Rückruf|Erreichbar|Bitte anrufen|Melden Sie sich) (unter|bei|an|) {phone}(.|)
(Appelez|Rappeler|Téléphonez|Contactez-nous) (le|au|) {phone}(.|)
(Llame|Llámenos|Contacte|Marque) (al|en el|el) {phone}(.|)
(Bellen|Bereikbaar|Neem contact op) (op|via|met) {phone}(.|)
{f} {x} {f} {phone} {f} {x}.
{firm}, {addr}, tel. {phone}
{name}, {phone}
{idword} {id}
{idword} {id}
{Idword}: {id}
{Idword} {id} ({x}|valid until {date}|issued {date}|expires {date})
(Her|His|My|Their|The tenant's|The guest's|Applicant's) {idword} (is|was|reads|=) {id}( now| and not {d4}|)(.|)
(Please|Do not|Never|Kindly) (store|delete|hide|check|enter|share|verify|redact|send) (the|their|my|) {idword} {id}(.|)
(Checked|Verified|Copied|Noted|Scanned|Presented|Shown|Held) {idword} {id} (at|for|on|with) (the|a) {w}.
{name}, {idword} {id}
{name} ({idword} {id}) (rents|buys|returns|collects|signed for) the {w}.
The {w} was (paid|collected|signed|returned|claimed|picked up) (with|against|under|on) {idword} {id}(.|)
{f} {x} {f} {idword} {id} {f} {x}.
(Address|Home address|Postal address|Street address|Residence|Location|Our office|Head office|Venue|Billing address|Delivery address|Ship-to|Deliver to|Mail to|Send to|Site|Premises|Property|Pickup at|Returns to)(:| -|) {addr}
(I|We|They|She|He) (live|lives|lived|moved|stay|work) (at|to|in) {addr}( now| since {date}|)(.|)
(The|A|Your) (parcel|shop|office|branch|house|flat|store|order|meeting|depot) (is|was|stands|goes|went) (at|to) {addr}(.|, {date}.|)
(Please|Kindly) (deliver|send|bring|ship|return|redirect|post) (it|them|the {w}|everything) to {addr}(.|)
(Meet|Find|See|Visit) (us|me|them) at {addr}( on {date}| at {h}|)(.|)
{name}\\n{addr}
{firm}\\n{addr}
{firm}\\n{addr}\\n{phone}
{firm}, {addr}
(Straße|Adresse|Anschrift des Kunden|Lieferung an|Rechnungsadresse|Wohnort|Standort|Filiale|Sitz)(:|) {addrde}
(Wir|Ich|Sie) (wohnen|wohne|wohnt|sind umgezogen) (in der|nach|jetzt) {addrde}(.|)
{f} {x} {f} {addrde} {f} {x}.
{firm}\\n{addrde}
(Adresse postale|Livraison|Siège|Lieu|Facturation|Domicile|Magasin|Agence)( :|) {addrfr}
(J'habite|Nous sommes|Livrez|Rendez-vous) (au|à l'adresse) {addrfr}(.|)
{f} {x} {f} {addrfr} {f} {x}.
{firm}\\n{addrfr}
(Dirección postal|Envío|Sede|Lugar|Facturación|Residencia|Tienda|Sucursal)(:|) {addres}
(Vivo|Vivimos|Envíen|Estamos) (en|a) {addres}(.|)
{f} {x} {f} {addres} {f} {x}.
{firm}\\n{addres}
(Postadres|Levering|Vestiging|Locatie|Factuuradres|Woonadres|Winkel|Bezorgadres)(:|) {addrnl}
(Ik woon|Wij wonen|Bezorg|Stuur) (op|aan|naar) {addrnl}(.|)
{f} {x} {f} {addrnl} {f} {x}.
{firm}\\n{addrnl}
""".strip().split("\n")

PLAIN = """
{firm}
{firm}\\n{x} {w}s and more
(Welcome to|Thank you for shopping at|Supplier:|Seller:|Vendor:|From|Sold by|Buyer:|Company:|Firma|Société|Empresa|Bedrijf) {firm}
(The|A|This|Our|Every|No) {adj} {w} {verb} (the|a|no|its) {w} {prep} (the|a) {adj} {w}.
(The|A|This|Our|Every|No) {w} {prep} the {w} {verb} (the|a|no|its) {adj} {w}( twice| again| today|)(.|, {m}.)
(When|If|Because|Although|While|Before|Since|As) (the|a) {w} {verb}, (the|no|each) {adj} {w} {verb} {prep} the {w}.
(Why|How|When|Where) (does|did|should|can) (the|a) {adj} {w} {prep} {w}?
(We|They|I|You|It|Nobody|Everyone) (cannot|must|should|will|did not|may) (find|open|see|read|move|pay|print) the {w} {prep} the {adj} {w}.
(Please|Kindly|Never|Always|Do not) (read|keep|open|check|note|return|print) the {adj} {w}(s|) {prep} the {w}(.|!)
(The {w}|It|This) (was|is|has been|will be) (closed|paid|read|found|changed|printed|sent|lost|moved) (by|with|after|before|on) (the|a) {w} {prep} {w}.
{Adj} {W}
{Adj} {W} {W}
{ADJ} {WW}
{W} {WW} {ADJ}
{W} and {W}
{Adj} {W} {m}
{d1} {adj} {w} {m}
{d1} x {Adj} {W} {m} {m}
{Adj} {W} {d1} {m}   {m}
{ADJ} {WW}  {d1} @ {m}   {m}
{W}\\t{d2}\\t{m}\\t{m}
{adj} {w} | {d2} | {m} | {m}
{d1}. {adj} {w} - {m}
(Subtotal|Total|Sum|Tax|VAT|Cash|Change|Balance|Amount due|Discount|Tip|Deposit|Summe|MwSt.|Gesamt|Bar|Rückgeld|Montant|TVA|Sous-total|Espèces|Importe|IVA|Efectivo|Cambio|Bedrag|Btw|Totaal|Wisselgeld)(:|  |) {m}
(Subtotal|Total|Net|Gross|Tax {d2}%|VAT {d1}%) {m}  {m}
{m}  {m}
{d2}  {m}  {m}
(Date|Datum|Fecha|Issued|Printed|Due|Time)(:|) {date}( {h}|)
{date} {h}
({W} )(opened|closed|printed|scanned) (on|at) {date}(, {h}|).
{codeword} {code}
{codeword} {code}
{codeword} {code}
{Codeword}: {code}
{Codeword} {code}, {codeword} {code}
(The|Your|This) {codeword} {code} (is|was|has been) (closed|paid|shipped|changed|opened|late|found) (on {date}|at {h}|)(.|)
(See|Check|Compare|Quote|Keep|Ship|Cancel|Return) {codeword} {code} (for|and|with|before|on) (the|a) {w}.
{code}
{firm}\\n{codeword} {code}\\n{date}
{f} {x} {f} {codeword} {code} {f} {x}.
{f} {x} {f} {f} {x} {f} {x} {f} {x}.
{F} {x} {f} {x}, {f} {f} {x} {f} {X} {f} {x} ({m}).
{F} {X} {f} {f} {X} {f} {x} {f} {X}.
{F} {x} {x} {f} {x} {f} {x} {f} {m} {f} {x}.
{X} {X} {f} {x}
{X}, {date}
{Town}, {date}
(In|Near|From|At|Around) {Town} (the|a|no) {w} {verb} {prep} the {adj} {w}.
(Made in|Printed in|Shipped from|Branch) {Town}
{W}.{w}[{d1}].{w}: {m} (<>|vs|but read) {m}
{w}_{w}={d3}; {w}.{w}{W}={m}
{w}.{w}.{w}{W} {verb} {w}
(GET|POST|INFO|WARN|ERROR|DEBUG) {d3} {w}/{w} {d4} ms
(http://|https://|www.){w}-{x}.(com|net|example|org)/{w}/{d3}
@{w}{d2} #{w} {w} :-)
(Hi|Hello|Dear|Good morning) (all|team|everyone|there|customer|Sir or Madam|colleagues)(,|!)
(Best|Kind|Warm) (regards|wishes),\\n(The|Your) (Team|Shop|Service Desk|Accounts Office|{W} Team)
(Mit freundlichen Grüßen|Cordialement|Saludos|Met vriendelijke groet)\\n{firm}
(Re|Fwd|AW|Subject|Betreff|Objet|Asunto|Onderwerp): {w} {prep} {adj} {w}( {d3}|)
(Sehr geehrte Damen und Herren|Madame, Monsieur|Muy señores míos|Geachte heer of mevrouw),
(Copy|Draft|Void|Paid|Original|Duplicate|Page {d1} of {d2}|- {d1} -|***|-----|======|* * *)
(Opening hours|Open|Öffnungszeiten|Horaires|Horario|Openingstijden)(:|) {h} - {h}
(Mon|Tue|Wed|Thu|Fri|Sat|Sun)(day|) {h}-{h}
(He|She|The {w}|They) (paid|read|printed|counted|entered) {m} (instead of|and not|or|for) {m}.
({W} {W}|{Adj} {W}) (is|was) {adj}, (so|but|and) the {w} {verb} {m}.
{firm} (says|paid|sent|wrote|delivered|wants|has) (the|a|no) {adj} {w}.
{firm} {verb} the {w} {prep} the {w}(, so|, but|) the {adj} {w} {verb} {m}.
"{Adj} {w} {prep} {w}"
({w}, {w}, {w} and {w}|{w}/{w}/{w})
{d3} {W} {W}, {d2} {w}s
(The|A|Our|This|No|Every|Any) {W} {W} (is|was|needs|{verb}|has no|can be) (the|a|no|{adj}) {w}(.|, {m}.)
(In|On|At|For|With|From|Before|After) (the|our|this|) {W} {W}, (the|a|no) {w} {verb} (the|a) {w}.
{W} {WW} (is|was|reads|shows|{verb}) (the|a|) {adj} {w}(.|;|:)
(see|read|check|use|write) {WW} {prep} {W} {WW}(.|)
{WW} {WW} (shows|reads|has|prints|{verb}) {m}( and {W} {WW} {m}|)(.|)
(The|A|An|This|Some) {adj}-{w} {w} {verb} (the|a|each) {w}-{w}(.|, {w}-{w}s and {adj}-{adj} {w}s.)
{Adj}-{w} {w} {prep} {w}-{w}
{w}-{w} {w} {prep} {adj} {w} {w} {verb} {w}
{w} {w} {verb} {w} {prep} {w} {w}; {w} {adj} {w}
{adj} {w} {w}
{w} {w}, {adj} {w} {w}: {m}
{w} {w} {w} {w}
(Thanks|Hi|Hey|Ask|Sorry|Welcome back|Bye),? {Given}(,|!|.)
{Given} (is|was) (late|away|here) (today|again|)(.|)
{W} {W} {verb} (the|a) {w}, {W} {W} {verb} (no|the) {w}.
{Town} (Station|Airport|Market|Museum|School|Library|Hospital|Bridge|Park|Hall|Office|Depot|Branch)( is closed| {verb} the {w}| was late|)(.|)
(Head|Chief|Senior|Junior|Regional|Night) {W} (Office|Officer|Manager|Desk|Clerk|Team|Department)
{X} {X} (oHG|e.K.|eG|SE|SpA|Oy|AB|A/S|SAS|SASU|S.r.l.|C.V.|V.O.F.)
{F} {X} {f} {X} {x} {f} {X} {X}, {f} {X} {x}.
{F} {x} {f} {f} {X} {X} {x} {f} {x}.
{X} {x} {f} {X} {x}: {m}
{X}-{X} {x} {f} {X}-{x}
{d2}% {prep} {d3} {w}s, {d1} {w} {prep} {d4}
""".strip().split("\n")


class Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):  # noqa: ANN001, ANN201
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def upper(self, n: int = 1) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))

    def form(self, *forms: str) -> str:
        """One of the printed forms, where 0 is any digit and A any capital letter."""
        return "".join(self.digits(1) if c == "0" else self.upper() if c == "A" else c for c in self.pick(forms))

    def syllables(self, least: int = 2, most: int = 3) -> str:
        starts, vowels, ends = "b c d f g h j k l m n p r s t v w z bl br ch cr dr fl fr gl gr kl kr pl pr qu sch sh sl sp st str th tr w y".split(), "a e i o u a e i o u a e ai au ea ee ei ie oo ou y ö ü é".split(), ["", "", "", "b", "ck", "d", "k", "l", "ll", "m", "n", "nd", "ng", "p", "r", "rt", "s", "st", "t", "x"]
        return "".join(self.pick(starts) + self.pick(vowels) + self.pick(ends) for _ in range(self.r.randint(least, most)))

    def word(self) -> str:
        return self.syllables(1, 3)

    def any_word(self) -> str:
        return self.pick(WORDS) if self.r.random() < 0.6 else self.word()

    def plain_letters(self, s: str) -> str:
        return s.translate(str.maketrans("öüé", "oue"))

    def family(self) -> str:
        if self.r.random() < 0.25:
            return self.pick(FAMILY)
        f = self.syllables(1, 3).capitalize()
        if self.r.random() < 0.3:
            f += self.pick("son sen mann ez ini ski er ton ley man berg stein feld ham ford well dal strom etti ova ic escu".split())
        r = self.r.random()
        return "O'" + f if r < 0.03 else "Mc" + f if r < 0.06 else self.pick(["van ", "von ", "de ", "van der ", "di ", "de la ", "Le "]) + f if r < 0.1 else f

    def name(self) -> str:
        r, g, f = self.r.random(), self.pick(GIVEN), self.family()
        if self.r.random() < 0.25:
            g = self.syllables(1, 3).capitalize()
        if r < 0.4:
            s = f"{g} {f}"
        elif r < 0.49:
            s = f"{f}, {g}"
        elif r < 0.59:
            s = f"{self.upper()}. {f}"
        elif r < 0.63:
            s = f"{self.upper()}. {self.upper()}. {f}"
        elif r < 0.72:
            s = f"{g} {self.upper()}. {f}"
        elif r < 0.78:
            s = f"{g}-{self.pick(GIVEN)} {f}"
        elif r < 0.85:
            s = f"{g} {f}-{self.family()}"
        elif r < 0.88:
            s = f"{g} {self.pick(GIVEN)} {f}"
        elif r < 0.985:
            s = f"{g} {f}".upper()
        else:
            s = f"{g} {f}".lower()
        return s

    def domain(self) -> str:
        w = lambda: self.plain_letters(self.word())
        return self.pick(["", "", "", "", "mail.", "shop.", "eu."]) + w() + self.pick(["", "", w(), "-" + w(), "-" + self.pick(WORDS)]) + self.pick([".com", ".org", ".net", ".de", ".fr", ".es", ".nl", ".co.uk", ".io", ".info", ".example", ".example.com", ".test", ".invalid"])

    def email(self) -> str:
        f, g, w = self.plain_letters(self.syllables(1, 3)), self.pick(GIVEN).lower(), self.pick(WORDS)
        local = self.pick([f"{g}.{f}", f"{g}.{f}", f"{g}{self.digits(2)}", f"{f}{self.digits(4)}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{f}.{g[0]}", f"{g}_{f}", f"{g}-{f}", f"{g}.{f}+{w}", w, f, f"{w}.{f}", f"{w}-{f}{self.digits(1)}", f"{g.capitalize()}.{f.capitalize()}"])
        at = self.pick(["@"] * 14 + ["(at)", " (at) ", "[at]", " [at] ", " @ ", " at ", " AT "])
        domain = self.domain()
        if at.strip().lower() == "at" or self.r.random() < 0.04:
            domain = domain.replace(".", self.pick([" dot ", " dot ", "[dot]", "(dot)"] if at != "@" else ["."]))
        s = local + at + domain
        return s.upper() if self.r.random() < 0.07 else s

    def phone(self) -> str:
        s = self.form(
            "000-000-0000", "000-000-0000", "000-000-0000", "(000) 000-0000", "(000) 000-0000", "000.000.0000", "000.000.0000", "000 000 0000", "000 000 0000", "000‑000‑0000", "+1 000 000 0000", "+1-000-000-0000", "+1 (000) 000-0000", "+10000000000", "1-000-000-0000", "001 000 000 0000", "000‑000‑0000", "0000000000",
            "020 0000 0000", "(020) 0000 0000", "01000 000000", "07000 000000", "+44 20 0000 0000", "+44 (0)20 0000 0000", "+44 7000 000000", "0044 20 0000 0000", "0000 000 0000",
            "030 0000000", "(030) 00 00 00", "030/000000", "030 / 000 00-00", "000 / 000000", "000 / 00000-00", "089-000000", "+49 30 0000000", "+49 (0)30 0000-000", "0049 30 00000 000", "0170 0000000", "0000 00 00 00", "00000/000000", "(00000) 0000-0",
            "01 00 00 00 00", "06.00.00.00.00", "+33 1 00 00 00 00", "+33 (0)6 00 00 00 00", "0033 1 00 00 00 00", "01-00-00-00-00", "0 800 000 000", "900 000 000", "600 00 00 00", "+34 600 000 000", "+34 91 000 00 00", "(+34) 000-000-000", "0034 000 000 000", "00 000 00 00",
            "020-0000000", "06 00000000", "06-00000000", "+31 6 0000 0000", "+31 20 000 0000", "+31 (0)20-0000000", "0031 20 000 0000", "+41 44 000 00 00", "+43 1 000 0000", "+32 2 000 00 00", "+39 06 0000 0000",
        )
        if self.r.random() < 0.16:
            s += self.pick([" ext. ", " ext ", " x", " x ", " extn. ", ", ext. ", " extension ", " Durchwahl ", " poste ", " toestel "]) + self.digits(self.r.randint(2, 4))
        return s

    def ident(self) -> str:
        return self.form(
            "000-00-0000", "000-00-0000", "000 00 0000", "000–00–0000", "A0000000", "A00000000", "AA0000000", "AA000000", "A 0000000", "AA 0000000", "00AA00000", "000000000", "0000000000", "00000000000", "AA 00 00 00 A", "AA000000A", "AA-00-00-00-A", "AA 000000 A",
            "00 000 000 000", "00 000000 A 000", "A00A00000", "0 00 00 00 000 000 00", "000000000000000", "00000000A", "00000000-A", "00.000.000-A", "A0000000A", "A-0000000-A", "A 0000000 A", "0000.00.000", "000.000.000", "000.0000.0000.00", "00.00.00-000.00",
            "00000000-0000", "000000-0000", "000.000.000-00", "0000 0000 0000", "000000/0000", "00000 00000", "000000-00-0000", "AAA000000", "A000-0000-0000", "00000000AA00",
        )

    def code(self) -> str:
        return self.form(
            "000000", "00000000", "000000", "0000", "00000", "000-00-0000", "000-00-0000", "000-00-0000", "000-00-0000", "0000 0000 0000", "A00000000", "AA000000", "AA-0000", "AA-000000", "A-00000", "AAA-000-000", "0000-000", "000-00-0000", "0000/000", "0000-00-000", "00000-A", "0A0000000000", "0A 000 000 00 0000 000 0", "AA000000000AA", "#0000", "000000000", "0000000000000", "A0000000", "AA0000000", "AAA00000", "000-0000-000",
            "0000 0000 0000", "00.000.00", "v0.00.0", "AA/0000/00", "000/000/00", "00-00-0000", "000000-00", "A0A-0A0", "000 000 000", "00000000-000", "AA00 0000 0000 0000 0000 00", "0000-0000-0000-0000", "AAAA-0000", "000A000", "00000 00000", "000-000-0000", "AA 00 00 00 A",
        )

    def place(self) -> str:
        return self.syllables(1, 2).capitalize() + self.pick(["", "", *"bridge brook burn bury by croft dale den field ford gate green ham haven hill hurst land ley mead mill moor park ridge shaw side stead stone ton vale view well wick wood worth".split()])

    def town(self) -> str:
        t = self.syllables(1, 2).capitalize() + self.pick(["", "", "", *"bach berg burg burgh bury dorf ford furt ham haven heim hausen kirchen mouth polis port stadt stead ton ville worth y".split()])
        return self.pick([""] * 9 + ["New ", "Fort ", "Saint ", "St. ", "North ", "South ", "West ", "East ", "Port ", "Mount ", "Lake "]) + t

    def addr(self) -> str:
        kinds = "Street St St. Avenue Ave Ave. Road Rd Rd. Lane Ln Ln. Drive Dr Dr. Court Ct Ct. Square Sq Boulevard Blvd Blvd. Highway Hwy Terrace Ter Place Pl Way Parkway Pkwy Crescent Close Trail Circle Str".split()
        n = str(self.r.choice([self.r.randint(1, 99), self.r.randint(1, 999), self.r.randint(1, 9999)])) + self.pick([""] * 12 + ["A", "b"])
        side = self.pick([""] * 6 + ["N ", "N. ", "North ", "S. ", "South ", "E ", "East ", "W. ", "West ", "NE "])
        street = f"{n} {side}{self.place()}{self.pick([''] * 5 + [' ' + self.place()])} {self.pick(kinds)}"
        unit = f"{self.pick(['Unit', 'Suite', 'Flat', 'Apt', 'Apt.', 'Apartment', 'Ste', 'Ste.', 'Floor', 'Room'])} {self.pick([self.digits(1), self.digits(2), self.digits(3), self.upper() + self.digits(1), self.digits(1) + self.upper()])}"
        r = self.r.random()
        street = f"{unit}, {street}" if r < 0.1 else f"{unit} {street}" if r < 0.13 else f"{street}, {unit}" if r < 0.22 else f"{street} {unit}" if r < 0.27 else f"{street} #{self.digits(2)}" if r < 0.32 else f"{street}\n{unit}" if r < 0.34 else street
        region = self.upper(2)
        sep = self.pick([", ", ", ", "\n", "\n", "\r\n", " "])
        post = self.form("00000", "00000", "00000", "A0 0AA", "AA00 0AA", "00000-0000")
        tail = self.pick(["", f"{sep}{self.town()}", f"{sep}{self.town()} {region} {post}", f"{sep}{self.town()}, {region} {post}", f"{sep}{self.town()}, {region}, {post}", f"{sep}{self.town()} {post}", f"{sep}{post} {self.town()}", f"{sep}{self.town()}, {region}"])
        s = (street + tail).rstrip(".")
        return s.upper() if self.r.random() < 0.12 else s.lower() if self.r.random() < 0.04 else s

    def addrde(self) -> str:
        base = self.syllables(1, 2).capitalize()
        street = self.pick([f"{base}straße", f"{base}str.", f"{base}weg", f"{base}platz", f"{base}allee", f"{base}gasse", f"{base}ring", f"{base}damm", f"{base}er Straße", f"Am {base}", f"An der {base}", f"Im {base}", f"{base}ufer", f"Alte {base}straße"])
        return f"{street} {self.r.randint(1, 250)}{self.pick(['', '', '', 'a', ' b', '-' + self.digits(1)])}{self.pick([', ', ', ', chr(10), ' '])}{self.digits(5)} {self.town()}"

    def addrfr(self) -> str:
        s = f"{self.r.randint(1, 250)}{self.pick(['', '', '', ' bis', ' ter', ','])} {self.pick(['rue', 'Rue', 'avenue', 'av.', 'bd', 'boulevard', 'place', 'impasse', 'chemin', 'allée', 'quai', 'route', 'cours'])} {self.pick(['', 'de ', 'de la ', 'des ', 'du ', 'Saint-'])}{self.syllables(1, 3).capitalize()}"
        return s + self.pick([", ", ", ", "\n", " "]) + f"{self.digits(5)} {self.town()}"

    def addres(self) -> str:
        s = f"{self.pick(['Calle', 'C/', 'C.', 'Avda.', 'Avenida', 'Av.', 'Plaza', 'Pza.', 'Paseo', 'Camino', 'Ronda', 'calle'])} {self.pick(['', '', 'de ', 'del ', 'de la '])}{self.place()}{self.pick([' ', ', ', ', n.º ', ' nº '])}{self.r.randint(1, 250)}" + self.pick(["", "", "", ", 2º B", ", 1º A", ", 3º izq.", ", 4.º dcha.", ", bajo", ", piso 2"])
        return s + self.pick([", ", ", ", "\n"]) + f"{self.digits(5)} {self.town()}"

    def addrnl(self) -> str:
        s = f"{self.pick(['', '', '', 'Oude ', 'Nieuwe '])}{self.syllables(1, 2).capitalize()}{self.pick(['weg', 'straat', 'laan', 'plein', 'gracht', 'kade', 'dijk', 'singel', 'steeg', 'hof'])} {self.r.randint(1, 250)}{self.pick(['', '', '', '-B', ' II', 'a', '-' + self.digits(1), ' hs'])}"
        return s + self.pick([", ", ", ", "\n", " "]) + f"{self.digits(4)}{self.pick([' ', ' ', ''])}{self.upper(2)} {self.town()}"

    def firm(self) -> str:
        a = self.pick([self.syllables(1, 3).capitalize(), self.place(), self.syllables(1, 2).capitalize() + " & " + self.syllables(1, 2).capitalize(), self.pick(ADJ).capitalize() + " " + self.pick(WORDS).capitalize(), self.town()])
        s = f"{a} {self.pick([*TRADES, self.pick(WORDS).capitalize()])} {self.pick(LEGAL)}".strip() if self.r.random() < 0.85 else f"{a} {self.pick(LEGAL[:15])}"
        return s.upper() if self.r.random() < 0.15 else s

    def money(self) -> str:
        a = self.r.choice([self.r.randint(0, 30), self.r.randint(0, 3000)]) + self.r.randint(0, 99) / 100
        return self.pick([f"{a:.2f}", f"{a:.2f}", f"{a:,.2f}", f"{a:.2f} EUR", f"${a:.2f}", f"£{a:.2f}", f"{a:.2f}".replace(".", ","), f"{a:.2f} €".replace(".", ","), f"{int(a)},000", f"{int(a)}.000", f"USD {a:.2f}", f"({a:.2f})", f"-{a:.2f}"])

    def date(self) -> str:
        y, m, d = self.r.randint(1998, 2029), self.r.randint(1, 12), self.r.randint(1, 28)
        month = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"][m - 1]
        return self.pick([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y % 100:02d}", f"{m}/{d}/{y}", f"{d:02d}-{month[:3]}-{y}", f"{d} {month} {y}", f"{month} {d}, {y}", f"{month} {d}", f"{d:02d}/{m:02d}/{y}", f"{d}. {month} {y}"])

    def hour(self) -> str:
        h, m = self.r.randint(0, 23), self.r.randint(0, 59)
        return self.pick([f"{h:02d}:{m:02d}", f"{h:02d}:{m:02d}", f"{h % 12 + 1} am", f"{h % 12 + 1}:{m:02d} pm", f"{h:02d}:{m:02d}:{self.digits(2)}", f"{h}.{m:02d} Uhr", f"{h}h{m:02d}"])

    def plain(self, key: str) -> str:
        if key[0] == "d" and key[1:].isdigit():
            return self.digits(int(key[1:]))
        if key in ("w", "W", "WW"):
            w = self.any_word()
            return w if key == "w" else w.capitalize() if key == "W" else w.upper()
        if key in ("adj", "Adj", "ADJ"):
            w = self.pick(ADJ) if self.r.random() < 0.7 else self.word()
            return w if key == "adj" else w.capitalize() if key == "Adj" else w.upper()
        if key in ("x", "X", "f", "F"):
            w = self.word() if key.lower() == "x" else self.pick(FOREIGN)
            return w if key.islower() else w.capitalize()
        if key in ("idword", "Idword", "codeword", "Codeword"):
            w = self.pick(ID_WORDS if key.lower() == "idword" else CODE_WORDS)
            return w if key.islower() else w[0].upper() + w[1:]
        return {"Given": lambda: self.pick(GIVEN), "verb": lambda: self.pick(VERBS) if self.r.random() < 0.7 else self.word() + "s", "prep": lambda: self.pick(PREPS), "Town": self.town, "code": self.code, "m": self.money, "date": self.date, "h": self.hour, "firm": self.firm}[key]()


MARKED = {"name": "person_name", "email": "email", "phone": "phone", "id": "id_number", "addr": "street_address", "addrde": "street_address", "addrfr": "street_address", "addres": "street_address", "addrnl": "street_address"}


def _filled(f: Filler, pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The pattern with its choices made and its holes filled, and the spans of the marked values."""
    while m := re.search(r"\(([^()]*\|[^()]*)\)", pattern):
        pattern = pattern[: m.start()] + f.pick(m.group(1).split("|")) + pattern[m.end() :]
    out, spans, at = "", [], 0
    pattern = re.sub(r" {2,}(?=[^ ])", " ", pattern) if "  {m}" not in pattern else pattern
    pattern = pattern.replace(" .", ".").replace("\\n", "\n").replace("\\t", "\t").strip()
    for m in re.finditer(r"\{(\w+)\}", pattern):
        out += pattern[at : m.start()]
        key = m.group(1)
        if key in MARKED:
            v = f.ident() if key == "id" else getattr(f, key)()
            spans.append((len(out), len(out) + len(v), MARKED[key]))
        else:
            v = f.plain(key)
        out += v
        at = m.end()
    out += pattern[at:]
    r = f.r.random()
    if r < 0.06 and len(out.upper()) == len(out):
        out = out.upper()
    elif r < 0.09 and len(out.lower()) == len(out):
        out = out.lower()
    return out, spans


def labelled_rows(n: int = ROWS, seed: int = 11, patterns: list[str] | None = None, plain: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n texts of one to five sentences with the spans (start, end, kind) of their values."""
    f = Filler(seed)
    marked, bare = patterns or PATTERNS, plain or PLAIN
    rows = []
    for _ in range(n):
        text, spans = "", []
        for k in range(f.r.randint(1, 5)):
            part, held = _filled(f, f.pick(marked if f.r.random() < 0.42 else bare))
            sep = "" if not k else f.pick(["\n", "\n", "\n", "\r\n", "\n\n", " ", " ", "  ", "\n   "])
            text += sep
            spans += [(a + len(text), b + len(text), kind) for a, b, kind in held]
            text += part
        rows.append((text, spans))
    return rows
