"""The small labelled table of problem 7: sentences with marked spans, and how their slots are filled.

``{N}`` person, ``{A}`` address, ``{P}`` phone, ``{I}`` identity number and ``{E}`` email are personal; ``{O}`` firm,
``{L}`` place, ``{S}`` station, ``{F}`` report, ``{V}`` vehicle, ``{D}`` date, ``{T}`` time, ``{R}`` amount, ``{C}`` code
and ``{#}`` number are not. ``{U}`` and ``{W}`` are a person and an address in Urdu, ``{Z}`` a place in Urdu. A bar in
square brackets separates wordings of which one is taken, so the few sentences stand for many.

The sentences are written for this table, from general knowledge of how reports, requests and answers sound; a test
checks that none of their longer parts stands in the test tables. Names, addresses, firms and stations are sampled
from columns that hold nothing else (``pii.sample_slots``).
"""

from __future__ import annotations

import random
import re

# The labelled sentences.
SENTENCES = """
[Yesterday|Last night|On Friday|Soon after] {N} [came|walked|ran|drove] to the [office|post|gate|yard] and [asked|begged|called] for help.
[The|Our|Their] [owner|neighbour|cashier|driver|guard|cook] {N} [denies|admits|recalls|insists on] [it|this|everything].
{N} [told|informed|warned] {N} about the [fire|debt|quarrel|missing goods].
[Statements of|Remarks by|Cross-examination of] {N} and {N} [remain|stay|are still] pending.
[Present:|Seen there:|Attending:] {N}, {N}, {N}.
{N}, {N} and {N} [signed|left|agreed|stood by|were heard] [at once|when asked|on {D}|].
{N}, {N} aur {N} [gaye|mile|khade thay].
{U}، {U} اور {U} [گئے|ملے|کھڑے تھے]۔
[Sign|Thumb mark|Seal]: {N}
[Buyer|Seller|Lessee|Surety|Heir]: {N}, [NIC|CNIC|card] {I}, [tel|ph|mob] {P}
{N} [s/o|d/o|w/o|son of|wife of|daughter of] {N} [has filed|moved|lodged] a [petition|grievance|request].
[Mr|Mrs] and [family of|friends of] {N} [paid|owe] Rs. {R} [in advance|since spring].
[wife of|brother of|uncle of] {N} [got hurt|went missing|was beaten] near {L}
{N}, [living|settled|residing|staying] at {A}, [heard shots|lost consciousness|locked the yard].
[Home|Postal address|Residence|Deliver to]: {A}
[Police went to|Officers raided|They searched|Burglars entered] {A} and [sealed|emptied|photographed] the rooms.
{A} [belongs to|is rented by|was bought by|stands empty since] {N}
[Bailiffs|Postmen|Couriers] [could not reach|were turned away from] {A} [twice|on {D}].
{N} [vacated|sublet|purchased|painted] {A} [for|against] Rs. {R}.
[they live in|she moved into|he stays at|my flat is] {A}
[Reach|Ring|Text|Dial|WhatsApp] [me|her|him|the clerk] [on|at] {P}[ any time| before noon| after office hours|].
[Her|His|My] [mobile|cell|landline|handset number] [is|was|reads] {P}.
{P} [is switched off|rang all night|belongs to {N}|was blocked on {D}]
[SIM|Line|Subscriber] {P} [issued to|held by|registered for] {N}, card {I}.
[Numbers|Both phones]: {P}, {P}
[Write|Reply|Forward it|Mail the scan] to {E}[ please| by {D}| and copy {N}|].
[Spam|An invoice|A ransom note|A reminder] [arrived|came] from {E}.
[mailbox|account|user id|login] {E} [is locked|was hacked|bounced]
{N} [uses|runs|forgot the password of] {E} and {P}.
{E} or {P} [work|will do] for [me|us|the family]
[NIC|CNIC|Identity card|Card no.|ID number|National identity] [#|is|:|reads|] {I}[ - expired| (copy enclosed)|, issued {D}|].
[An|The|His|Her|Some] [identity|card|ID|CNIC] number {I} [was read out|came up|at|on] [the desk|a form|the border|].
[the bearer of|a person holding|somebody with] {I} [boarded a bus|opened an account|left the country].
{I} [is registered to|matches|does not match|was cancelled for] {N}
[Check|Trace|Verify|Look up] [the card|identity] {I} [for me|again|tonight]
[Do we know|Has anyone met|Where is|Who is|Why was] {N}[ now| these days| kept in custody|]?
[Tell me|I need|Show] [everything on|the past of|any charge against] {N} [and|or] {N}[ quickly|].
[Is|Was] {N} [from|of] {A} [a suspect|on bail|heard in court] in {F}?
[What became of|How old is|Which car has] {N}?
[Regards|Yours truly|Sincerely|Thanks], {N}
[hi|salam|dear sir], [this is|i am|my name:] {N}[, cnic {I}|, {P}|], [where is my file|any news on my complaint {#}]?
[could you send|kindly forward] [the slip|a copy of {F}] to {E}[, {N}|]
[Do you have|Is there] [any trace of|a file under] {I} or {P}[ in the archive|]?
[Who lives at|Was anybody found at|How far is it to] {A}?
[Yes|Indeed|Correct], {N} [signed|was questioned|gave way] on {D} [Document 2].
{N} [appears|is listed|was heard] as a [bystander|co-accused|referee] in {F}, [reachable on|phone] {P} (Document 6).
{N} [and|with] {N} share {A} [as per the deed|says the land office] [Document 1].
[Summons|A letter|Bail papers] [went out|were posted] to {A} and to {E} [Document 3].
[File|Sheet|Page] {#} [ties|links] {I} to {N} of {A}.
{N} [was held|surrendered|got bail] under {X} and [freed|sentenced] on {D}.
[Evidence|Testimony] by {N} was [noted|taped] at {T}, {N} [interpreting|watching].
{N} [wept|smiled|fainted|left]. {N} [stayed|followed|laughed].
[Deceased|Injured|Victim|Accused|Petitioner|Informer] {N} [aged {#}|of {L}|, a tailor,] [fell|fled|was hit] [at {T}|on {D}].
[car of|shop of|plot of|cousin of|against|from|with|by|for|to|and] {N}
[Loan|Rent|Dowry|Wages] [due to|unpaid by|taken from] {N}: Rs. {R}
{N} [ka bhai|ki walida|ke walid|ka dost] [lapata hai|zakhmi hua|bhaag gaya].
[Kal|Parson|Subah|Raat ko] {N} [aya|gayi|pohancha] aur [shor machaya|darwaza toda|paise maange].
{N} [bola|boli|kehti hai|keh raha tha] keh {G} [ghayab hai|chheen liya].
[Mujrim|Gawah|Malik|Chowkidar|Saail] {N} walad {N}, [pata|rehaish] {A}
{N} [aur|or] {N} [ne jhagra kiya|ka len den tha|ko bulaya gaya].
[Ghar|Pata|Makan ka pata]: {A}
{A} [wala makan|mein aag lagi|ka kiraya baqi hai|se saman uthaya]
[Raabta|Fon|Mobile|Cell no]: {P}
[mujhe|usay|hamein] {P} par [call karo|message karo|batayein]
[Shanakhti card|CNIC|NIC] {I} [jali nikla|ka malik {N} hai|dikhaya gaya].
{E} par [jawab bhejein|copy bhejo|likha tha]
[kya|kab|kahan|kyun] {N} [giraftar hua|mila|rehta hai|ko chhora gaya]?
[main|mera naam|banda] {N} [hoon|hai][, fon {P}|, card {I}|][, meri file kahan hai|]
[batao|dekho|check karo] {I} [kis ka card hai|par koi case hai]
{P} [kis ki sim hai|band kyun hai|se dhamki mili]
[Ji haan|Haan], {N} [ne dastakhat kiye|pesh hua|bari hua] [Document 7].
[کل|پرسوں|صبح|رات کو] {U} [آیا|گئی|پہنچا] اور شور مچایا۔
{U} [کا بھائی|کی والدہ|کے والد|کی دکان] [لاپتہ ہے|زخمی ہوا|بند ہے]۔
{U} [اور|،] {U} [نے جھگڑا کیا|کا لین دین تھا|کو بلایا گیا]۔
[ملزم|گواہ|مالک|چوکیدار|سائل|مقتول|متاثرہ] {U} [ولد|بنت|زوجہ] {U}، [پتہ|رہائش|ساکن] {W}
[پتہ|گھر|رہائش]: {W}
{W} [میں آگ لگی|سے سامان اٹھایا|کا کرایہ باقی ہے|پر چھاپہ مارا]۔
{U} [نے|کو|سے|پر|کا|کی] [کہا|مارا|ملا|بھیجا|دیکھا]
[فون|موبائل|نمبر|رابطہ]: {P}
[مجھے|اسے|ہمیں] {P} پر [کال کریں|پیغام دیں]۔
[قومی شناختی کارڈ|شناختی کارڈ|کارڈ] {I} [جعلی نکلا|{U} کا ہے|گم ہو گیا]۔
{E} پر [جواب بھیجیں|نقل بھیجیں|لکھا تھا]۔
[کیا|کب|کہاں|کیوں] {U} [گرفتار ہوا|ملا|رہتا ہے|کو چھوڑا گیا]؟
[میں|میرا نام|بندہ] {U} [ہوں|ہے]، [فون {P}|کارڈ {I}]، میری فائل کہاں ہے؟
[دیکھیں|بتائیں] {I} [کس کا کارڈ ہے|پر کوئی کیس ہے]
{P} [کس کی سم ہے|بند کیوں ہے|سے دھمکی ملی]؟
[جی ہاں|ہاں]، {U} [نے دستخط کیے|پیش ہوا|بری ہوا] [Document 7]۔
[The|A|This|That|Every|No] [lane|bridge|canal|crossing|market] [at|by|behind|towards] {L} [stays|was|is] [dark|shut|flooded|crowded].
[Between|Around] {L} and {L} [traffic stopped|wires were cut|dogs barked].
{L}
[In|Across|Around|Near|Of|Inside] {L}[,|] {#} [people|shops|homes|trees|thefts|men] [were|voted|closed|burnt|lived] [{D}|later|].
[the fog|a blackout|the fair|the strike|patrols] [in|over|at|of] {L}.
[road|way|bus] to {L}, {L} or {L} [{#} km|]
[Staff|Clients|Invoices|Partners] of {O} [complained|vanished|refused to pay].
{O} [sells|repairs|imports|owes] {G}[ since {D}| for Rs. {R}|].
[deal|contract|dispute] with {O} in {L}
{S} [forwarded|archived|returned|reopened] {F} on {D}.
[Officers of|The desk at|Nobody in] {S} [took notes|answered|had the key].
[Frame|Engine|Chassis|Serial|Batch|Tag|Seal|Lot] [no.|number|code|] {C}[ scratched| readable|].
[IMEI|Handset code|Device id] {M}[, blocked| not on file|].
[Courier|Cargo|Airway bill|Shipment|Tracking|Consignment|Postal docket|Docket] [no|number|slip|code|] {K} [left the depot|is lost|was opened|came back].
[Goods|Freight|Cargo|Consignment|Waybill] [no|number] {K} [sat|stood|was weighed|was detained|is delayed] [at|near|behind] the [depot|border|scales|barrier|customs] [on {D}|].
[Consignment|Shipment] {K} [and|or] [waybill|parcel no] {K} [differ|arrived].
[Bill|Invoice|Voucher|Token|Challan|Receipt] {#}-{#} [over|of] Rs. {R}.
[Pump|Meter|Boiler|Gauge] {#}-{#}-{#}, [reading|type|lot] {#}.
[Serial|Part|Version] 92-{#}-{#} and 0{#}-{#}
{V} [hit a pole|was towed|is stolen|belongs to {O}].
[truck|bike|rickshaw|van] {V} or {V}
[Please|Kindly|Could you] [list|count|explain|compare|translate] [all entries|the seizures|both reports] [of|for] {F}.
[What|Which|When|Why|How|Who|Where|Whose] [rule|fee|court|form|deadline|officer|record] [covers|applies to|follows from] {X}?
[How do I|Can one|May we|Should I] [appeal|renew a licence|get bail|see the ledger|object] [at|in] {S}?
[Compare|Summarise|Outline|Describe|Draft] [the raid|what happened|every step] [in|of] {F} [from|until] {D}.
[does|did] {V} [turn up|show] in {F}?
[my passport|a cheque book|my bag] [was lost|got stolen] in {L}, [what now|where do I go]?
[Charges|Counts] under {X} [lapse|carry bail|need a warrant].
[First|Second|Third|Another|Last] [hearing|raid|search] [on|set for] {D} [Document 5].
[None|Some|Most|Two] of the [cameras|locks|goats|papers] [worked|were found|were marked {C}].
[Ballistic|Medical|Forensic|Audit] [report|notes] {#} [agree|differ] [Document 8].
[Bring|Carry|Attach|Hand in] [two photos|a stamped form|old receipts] and Rs. {R} [to the counter|at {S}].
[It|He|She|They|We|I|You] [was|were|had|did|will|can] [late|seen at {T}|asked to wait|not there].
[Sorry|Unfortunately|Alas], [this|that|the request] [is beyond|lies outside] [my role|our files].
[Ask|See|Consult] [a lawyer|counsel|the desk|an advocate] [first|instead|in person].
[Yes|No|Maybe|Never|Twice|Unknown], [at {T}|on {D}|see {F}|about Rs. {R}]
[Gari|Motor cycle|Truck] {V} [pakri gayi|chori hui|jal gayi].
{L} [mein|ke paas|se|tak] [andhera tha|rasta band hai|shor hua].
{O} [ka munshi|ka hisab|wale] [nahi mila|baqi hai|aye].
{S} [mein kon hai|ka number kya hai|ne file band ki].
[Parcel|Saman|Raseed|Builty] {K} [wapis aya|gum hai].
[fees kitni hai|kahan jana hai|kaise likhen|kis dafa mein|kab milegi] [{F}|{X}|]?
[Agli|Pichli] tareekh {D}, [adalat band thi|wakeel nahi aya].
[file|case|parcha] {F} [khula hai|band hai|dobara khula]
[{G} aur {G}|{#} cheezen|naqdi Rs. {R}] [mili|wapis hui|mohar {C} ke sath rakhi].
[koi baat nahi|mujhe nahi pata|yeh mumkin nahi|aap khud dekhein]
[گاڑی|موٹر سائیکل|ٹرک] {V} [پکڑی گئی|چوری ہوئی|جل گئی]۔
{Z} [میں|کے پاس|سے|تک] [اندھیرا تھا|راستہ بند ہے|شور ہوا]۔
{Z} [میں|کے] {#} [گھر|دکانیں|لوگ|واقعات] [جلے|بند رہے|ہوئے]۔
[گاڑی|بائیک|ٹرک|رکشہ] نمبر {V} [کس کی ہے|کہاں کھڑی ہے|کب ملی|جل گئی]؟
{V} [کس کی ہے|کہاں کھڑی ہے|کب ملی]؟
{Z} [کہاں ہے|کی سڑک|کا بازار]
[پارسل|سامان|رسید|بلٹی] {K} [واپس آیا|گم ہے]۔
[فیس کتنی ہے|کہاں جانا ہے|کیسے لکھیں|کس دفعہ میں|کب ملے گی] [{F}|{X}|]؟
[اگلی|پچھلی] تاریخ {D}، [عدالت بند تھی|وکیل نہیں آیا]۔
[فائل|کیس|پرچہ] {F} [کھلا ہے|بند ہے|دوبارہ کھلا]۔
[{#} چیزیں|نقدی {R}|زیورات|کپڑے|گھڑی|بیگ] [ملی|واپس ہوئی|تھیلے میں رکھی] [مہر|نشان] {C}۔
[لیپ ٹاپ|سونے کی انگوٹھی|چابیاں|کاغذات|رقم] اور [پرس|موبائل|سائیکل|کمبل] [غائب ہے|ملے|جمع ہیں]۔
[درخواست|شکایت|نقل|فارم|لائسنس|پاسپورٹ|بیان|گواہی|ضمانت|نوٹس|وارنٹ|فہرست] [گزار|دہندہ|نامہ|کنندہ|نمبر|والا] [کو|کے|کی|نے|سے] [دفتر|عدالت|کچہری|جیل|تھانے|سرکار] [جانا|آنا|لکھنا|بتانا|لے جانا] [ہے|ہوگا|تھا|پڑے گا]۔
[گم شدہ|جعلی|پرانی|نئی|کھوئی ہوئی|ضبط شدہ|سرکاری|ذاتی] [چیز|مہر|گاڑی|دستاویز|رقم|سند|بندوق|تصویر] [کی|کا|کے] [رپورٹ|اطلاع|تفصیل|قیمت|جانچ] [کس طرح|کدھر|کتنے میں|کب تک] [ہوگی|ملے گی|درج ہو گی|ہو سکتی ہے]؟
[پہلے|دوسرے|تیسرے|بعض|تمام|اکثر|جبکہ|چنانچہ|لہذا|اگرچہ|تاہم] [لوگ|گواہ|افسران|ملازم|سوال|صفحات] [کہتے ہیں|خاموش رہے|متفق ہیں|مختلف ہیں|درست ہیں] [Document 1]۔
[اس|ان|جس|کسی|ہر] [معاملے|سوال|فائل|علاقے|قانون|ریکارڈ|دستاویز] [پر|میں|کا|سے متعلق] [بات|جواب|علم|اجازت|معلومات|رسائی] [نہیں|ممکن ہے|درکار ہے|ملتی ہے]۔
[کوئی بات نہیں|مجھے نہیں پتہ|یہ ممکن نہیں|آپ خود دیکھیں|انتظار کریں]۔
[سماعت|رپورٹ|تلاشی|دفتر|درخواست|پولیس|حکم] [جاری ہے|ملتوی ہوئی|مکمل ہے|نامکمل ہے|نہیں ہوئی]۔
[ایک|دوسرا|کوئی|وہ|یہ] [آدمی|عورت|لڑکا|افسر] [بھاگ گیا|چپ رہا|آگے بڑھا] [{T}|{D} کو|]۔
[Le|La|Un|Une|Votre|Cette] [voiture {V}|dossier {F}|reçu {#}|bureau|loi] [coûte|reste|est] [Rs. {R}|ouvert|utile]{.}
[Nous|On|Il|Elle] [ne sait rien|attend la suite|revient le {D}].
[{V}|{X}|{F}|{T}|{D}|Rs. {R}|{#}]
[{V}, {V} and {V}|{G}, {G}|at {T} or {T}|{X} read with {X}|{F} and {F}]
""".strip().split("\n")

PERSONAL = {"N": "name", "U": "name", "A": "address", "W": "address", "P": "phone", "I": "identity_number", "E": "email"}
# Words the slots without personal data are filled with.
_SORTS = ["Town", "Colony", "Nagar", "Bazar", "Mohalla", "Park", "Road", "Chowk"]
_TRADES = ["Traders", "Motors", "School", "Hospital", "Builders", "Mills", "Agency", "Brothers", "& Sons", "(Pvt) Ltd"]
_GOODS = ["a necklace", "a motor bike", "a smart phone", "steel pipes", "a computer", "a tractor battery", "a bunch of papers", "two cows", "a generator", "cash", "a purse", "old coins"]
_HOSTS = ["example.com", "example.org", "mail.example.net", "office.example", "shop.test", "post.invalid", "my-firm.example.com", "a1.test"]
TITLES = ["Mr. ", "Mr ", "Dr. ", "Dr ", "Mst. ", "Mst ", "Mrs. ", "Mrs ", "Miss ", "Ms. ", "Haji ", "Hafiz ", "Ch. ", "Syed ", "Sheikh ", "Malik ", "Prof. ", "Adv. "]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _script(r: random.Random, s: str) -> str:
    return s.translate(str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹")) if r.random() < 0.1 else s


def _phone(r: random.Random) -> str:
    a, b, c = "0" + r.choice("123456789") + _digits(r, 2), _digits(r, 3), _digits(r, 4)
    return _script(r, r.choice([f"{a}-{b}{c}", f"{a}{b}{c}", f"{a} {b} {c}", f"({a}) {b}{c}", f"({a}) {b}-{c}", f"+92-{a[1:]}-{b}-{c}", f"+92 {a[1:]} {b}{c}", f"0092{a[1:]}{b}{c}", f"{a} {b}{c}"]))


def _identity(r: random.Random) -> str:
    a, b, c = r.choice("123456789") + _digits(r, 4), _digits(r, 7), _digits(r, 1)
    return _script(r, r.choice([f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}{b}{c}", f"{a}{b}{c}", f"{a}{b}{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}–{b}–{c}"]))


def _email(r: random.Random, names: list[str]) -> str:
    parts = [p.lower() for p in r.choice(names).replace(".", " ").split() if p.isalpha() and p.isascii()] or ["office"]
    user = r.choice([parts[0] + _digits(r, 2), f"{parts[0]}.{parts[-1]}", f"{parts[0][0]}_{parts[-1]}", f"{parts[0]}+{_digits(r, 3)}"])
    host = r.choice(_HOSTS)
    s = r.choice([f"{user}@{host}"] * 4 + [f"{user} @ {host}", f"{user}(at){host}", f"{user} [at] {host.replace('.', ' [dot] ')}"])
    return s.upper() if r.random() < 0.1 else s


def _date(r: random.Random) -> str:
    y, m, d = r.randint(1995, 2040), r.randint(1, 12), r.randint(1, 28)
    return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}-{m:02}-{y}", f"{d:02}/{m:02}/{y}"])


def _made_up(r: random.Random) -> str:
    return "".join(r.choice("bdghjklmnprstz") + r.choice("aeiou") for _ in range(r.randint(2, 4))).capitalize() + r.choice(["", "r", "n", "l"])


def _letters(r: random.Random, n: int) -> str:
    return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))


def _other(kind: str, r: random.Random, pools: dict[str, list[str]]) -> str:
    code = "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ0123456789") for _ in range(9))
    return {
        # one in four is made up, so that the words alone don't tell
        "L": lambda: r.choice(pools["L"]) if pools["L"] and r.random() < 0.75 else f"{_made_up(r)} {r.choice(_SORTS)}",
        "Z": lambda: r.choice(pools["Z"]) if pools["Z"] else "پرانا شہر",
        "S": lambda: r.choice(pools["S"]) if pools["S"] and r.random() < 0.75 else f"PS {_made_up(r)}",
        "O": lambda: r.choice(pools["O"]) if pools["O"] and r.random() < 0.75 else f"{_made_up(r)} {r.choice(_TRADES)}",
        "G": lambda: r.choice(_GOODS),
        "F": lambda: f"FIR-{r.randint(1995, 2040)}-{_letters(r, r.randint(4, 8))}-{_digits(r, 4)}",
        "V": lambda: f"{_letters(r, 3)}-{_letters(r, 1)}-{_digits(r, 4)}",
        "D": lambda: _date(r),
        "T": lambda: r.choice([f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", f"{r.randint(1, 12)}.{r.randint(10, 59)} {r.choice(['am', 'pm'])}"]),
        "R": lambda: f"{r.randint(1, 899)},{_digits(r, 3)}",
        "C": lambda: code,
        "K": lambda: _digits(r, 13),
        "M": lambda: _digits(r, 15),
        "X": lambda: f"{r.randint(100, 499)}" + r.choice(["", "-A", "-B", "(2)"]) + " " + r.choice(["PPC", "CrPC", "PECA", "CNSA"]),
        "#": lambda: _digits(r, r.choice([1, 2, 3, 4, 5, 6])),
        ".": lambda: r.choice([".", "", " !"]),
    }[kind]()


def _name(r: random.Random, names: list[str]) -> str:
    s = r.choice(names)
    x = r.random()
    if s.isascii() and 0.25 <= x < 0.4 and s.count(" ") and s[1] != ".":
        first, _, rest = s.partition(" ")
        return f"{first[0]}. {rest}" if x < 0.3 else f"{first[0]}. {rest.rpartition(' ')[2]}"
    if s.isascii() and x < 0.25:
        return s.upper() if x < 0.12 else s.lower() if x < 0.2 else r.choice(TITLES) + s
    return s


_CHOICE = re.compile(r"\[([^\[\]]*\|[^\[\]]*)\]")


def literal_parts() -> list[str]:
    """What the sentences say around their slots, every wording of a choice by itself."""
    parts: list[str] = []
    for line in SENTENCES:
        parts += [p for p in re.split(r"\{.\}", _CHOICE.sub(" {#} ", line))]
        parts += [p for m in _CHOICE.finditer(line) for w in m[1].split("|") for p in re.split(r"\{.\}", w)]
    return [p.strip() for p in parts if p.strip()]


def labelled_texts(names: list[str], addresses: list[str], count: int, seed: int = 1, others: dict[str, list[str]] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts of one to three sentences with their spans ``(start, end, kind)``.

    ``names`` and ``addresses`` fill the personal slots; Latin and Urdu ones go into sentences of their script.
    ``others`` may hold firms (``O``), places (``L``, in Urdu ``Z``) and stations (``S``).
    """
    r = random.Random(seed)
    latin, urdu = [n for n in names if n.isascii()], [n for n in names if not n.isascii()]
    homes, homes_ur = [a for a in addresses if a.isascii()], [a for a in addresses if not a.isascii()]
    pools = {"N": latin or ["Ali Khan"], "U": urdu or ["علی خان"], "A": homes or ["House No. 7, Street 3, Old Town"], "W": homes_ur or ["مکان نمبر 7، گلی نمبر 3"]}
    fill = {k: list((others or {}).get(k, [])) for k in "LZSO"}
    out = []
    for _ in range(count):
        text, spans = "", []
        for n in range(r.choice([1, 1, 2, 3])):
            line = r.choice(SENTENCES)
            while m := _CHOICE.search(line):
                line = line[: m.start()] + r.choice(m[1].split("|")) + line[m.end() :]
            if n:
                text += r.choice([" ", " ", "\n", "  "])
            # answers may be lists
            text += r.choice([""] * 6 + ["- ", "1. ", "2. ", "[Document 3] ", "(Document 5) "])
            at = 0
            while at < len(line):
                if line[at] == "{":
                    slot = line[at + 1]
                    if slot in ("N", "U"):
                        value = _name(r, pools[slot])
                    elif slot in pools:
                        value = r.choice(pools[slot])
                    elif slot == "P":
                        value = _phone(r)
                    elif slot == "I":
                        value = _identity(r)
                    elif slot == "E":
                        value = _email(r, pools["N"])
                    else:
                        value = _other(slot, r, fill)
                    if slot in PERSONAL:
                        spans.append((len(text), len(text) + len(value), PERSONAL[slot]))
                    text += value
                    at += 3
                else:
                    text += line[at]
                    at += 1
            if r.random() < 0.3:
                text = text.rstrip(".۔") if not spans or spans[-1][1] < len(text) else text
        out.append((text, spans))
    return out
