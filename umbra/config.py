"""What counts as personal data: entity types, thresholds, term lists and run options."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Entity types in the order in which overlapping spans of one length are preferred. Fixed values.
PRIORITY = (
    "EMAIL_ADDRESS", "URL", "IN_AADHAAR", "IN_PAN", "CREDIT_CARD", "US_SSN", "IP_ADDRESS", "PHONE_NUMBER", "DATE_OF_BIRTH", "IN_DIN", "ADDRESS", "ORGANIZATION", "PERSON",
)
ENTITIES = frozenset(PRIORITY)
#: Types of rule-based names, and what they become. Fixed values.
ALIASES = {"ORG_SUFFIX": "ORGANIZATION", "PERSON_LABELLED": "PERSON"}
#: Least scores; all others 0.5. Fixed values.
THRESHOLDS = {"DATE_OF_BIRTH": 0.4, "IN_DIN": 0.4, "IN_AADHAAR": 0.4, "PHONE_NUMBER": 0.4, "IN_PAN": 0.5, "US_SSN": 0.5, "URL": 0.5}
DEFAULT_THRESHOLD = 0.5
#: Where a span came from.
NER, ORG_RULE, LABEL_RULE, PROPAGATED, ADDRESS_BLOCK, SHORT_FORM, CONTINUATION = "ner", "org_suffix", "contact_person", "propagation", "address_block", "short_form", "continuation"


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def phrases(text: str) -> frozenset[str]:
    return frozenset(x.strip() for x in text.split(",") if x.strip())


# ---- legal forms

#: How the names of companies end. Fixed values.
ENDINGS = ("Private Limited", "Pvt. Ltd.", "Limited", "Ltd.", "LLP", "L.L.P.", "Family Trust", "Trust", "Foundation", "Bank of India", "Bank", "Associates", "N.A.")
#: Also dropped from the end of a name to make it short.
MORE_ENDINGS = ("Securities",)
#: Parts of endings that stay in capitals.
CAPITAL_ENDINGS = words("llp l.l.p n.a")

# ---- who isn't a name. Lower case throughout.

#: A job title is a head with any of the modifiers before it, or such titles joined by "and".
TITLE_HEADS = words(
    "accountant accountants administrator agent agents ambassador analyst applicant applicants architect attorney auditor auditors banker bankers beneficiary bidder bidders broker brokers buyer chair chairman chairperson "
    "chairwoman client clients clerk coach commissioner consultant controller coordinator counsel customer customers dean director directors doctor editor employee employees engineer engineers executive founder founders "
    "governor guarantor head holder inspector investor investors issuer judge lawyer lecturer lender lessee lessor librarian manager managers mayor member members minister nurse officer officers operator owner partner "
    "partners personnel physician president principal professor promoter promoters proprietor receptionist registrar representative scientist secretary seller settlor shareholder shareholders signatory solicitor "
    "specialist supervisor surgeon surveyor teacher technician tenant treasurer trustee trustees underwriter underwriters vendor vendors"
)
TITLE_MODIFIERS = words(
    "acting additional anchor area assistant associate authorised book branch chartered chief committee commercial company compliance corporate deputy designated divisional executive field finance financial former general "
    "grievance group human independent information institutional internal interim investor joint key lead legal managerial managing marketing medical nominee non-executive operating operations principal production "
    "project purchase quality regional relations resident resources retail retired running sales selling senior site staff statutory support syndicate technical technology vice whole-time works the a an our to of offer"
)
#: Offices and bodies that are public knowledge; their names, addresses and sites stay readable.
PUBLIC_BODIES = phrases(
    "reserve bank of india, rbi, securities and exchange board of india, sebi, bse, bse limited, nse, national stock exchange, national stock exchange of india, national stock exchange of india limited, "
    "ministry of corporate affairs, ministry of finance, ministry of health, ministry of external affairs, registrar of companies, roc, income tax department, election commission of india, supreme court, "
    "supreme court of india, high court, parliament of india, government of india, central government, state government, unique identification authority of india, uidai, competition commission of india, "
    "central depository services (india) limited, cdsl, national securities depository limited, nsdl, united nations, world health organization, european union, world bank, internal revenue service, "
    "securities and exchange commission, federal reserve, department of justice, social security administration, postal service"
)
#: Sites of such bodies. Fixed values.
PUBLIC_DOMAINS = ("sebi.gov.in", "bseindia.com", "nseindia.com", "rbi.org.in", "mca.gov.in", "gov.in")
#: Words of contracts and securities: with one of them, and no word of companies, a phrase is a defined term.
LEGAL_TERMS = words(
    "act addendum affidavit agreement allotment amendment annexure appendix arbitration article articles bid board bond bonds bye-laws certificate chapter charter circular clause code committee contract covenant debenture "
    "debentures deed demat directive dividend draft equity escrow exhibit filing fiscal gazette guidelines herring indemnity indenture index issue law lease liability licence listing mandate memorandum mortgage notification "
    "offer offering order ordinance petition policy portion prospectus protocol provision quarter record register regulation regulations report resolution rule rules schedule scheme section securities share shares "
    "statement statute stock subscription summons table tariff tax tender term terms treaty undertaking voucher warrant"
)
#: What a defined term ends with.
TERM_TAILS = words("act acts agreement agreements circular circulars committee guidelines issue offer policy portion prospectus regulation regulations report reports rule rules scheme schemes")
#: Words that are typical of names of companies and institutions.
ORG_WORDS = words(
    "academy advisors agency airlines analytics associates bank breweries brothers builders capital clinic club co college communications company constructions consultants consulting corp corporation council dairy "
    "electronics energy engineering enterprises exports finance foods foundation freight group holdings hospital hotels inc industries infrastructure institute insurance international investments labs laboratories limited "
    "llc llp logistics ltd manufacturing media mills motors networks partners pharma pharmaceuticals power private properties pvt realty resorts retail securities services shipping society software solutions steel studio "
    "studios systems technologies telecom textiles traders transport trust university ventures works"
)
#: What stands before or after a value in forms and letters.
LABELS = words(
    "address attention attn birth by cell cin client contact customer date designation din dob dr email e-mail fax for from mail miss mobile mr mrs ms name names no nos number pan passport patient person persons "
    "phone ref reference regards sent shri signed sincerely smt sr tel telephone to user website with"
)
#: Ordinary words that headings and sentences write with a capital.
GENERIC = LEGAL_TERMS | words(
    "a an the this that these those each every both all some any no not our your their his her its we you they he she it i who which what where when why how if as at in on of or and but by for from with into over under "
    "after before during between since until about also here there new old first second third next last other such same more most many few several one two three four five six seven eight nine ten "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday spring summer autumn winter morning evening "
    "north south east west northern southern eastern western central upper lower national international global local public general special annual monthly weekly daily "
    "account amount appointment balance booking building case category city class copy country course department description desk details district document email entry event example fee figure file floor form "
    "guide help home hours house information introduction invoice item key level line list map message method model month note number office page part payment phase phone photo plan please post price problem product "
    "programme project purpose question receipt request result review room route sample series server service session set size source staff state status step street subject summary support system team test text ticket "
    "time title total town tracking train type unit update use user value version village visit week welcome work year yes"
)

# ---- names of people: common in India and in English-speaking countries

GIVEN_NAMES = words(
    "abhishek aditi aditya ajay akash amar amit amrita anand anil anita anjali ankit anupam arjun arun asha ashok bharat chandra deepa deepak dev dinesh divya farah gaurav geeta gopal govind hari harish imran indira isha "
    "jaya karthik kavita kiran krishna kumar lakshmi lalita leela madhav mahesh manish manoj maya meena meera mohan mukesh nandini naresh naveen neha nikhil nisha om padma pooja pradeep prakash priya radha rahul raj "
    "rajesh rakesh ramesh ravi rekha rohan rohit sachin sandeep sanjay sarita shreya shyam sita sneha sunil sunita suresh swati tara uma vijay vikram vinod vivek yash "
    "adam alan alice amanda andrew angela anna arthur barbara benjamin brian carol charles charlotte christine claire daniel david deborah diana donald edward elizabeth emily emma eric eva frank george grace hannah "
    "harold helen henry ian isabel jack jacob james jane janet jason jennifer jessica john jonathan joseph joyce julia karen keith kevin laura leo linda lisa lucas lucy margaret maria mark martha martin mary matthew "
    "michael michelle nancy nathan nicholas nora oliver olivia oscar patricia paul peter philip rachel rebecca richard robert roger rose ruth samuel sandra sarah scott simon sophia stephen steven susan theodore thomas "
    "timothy victor victoria vincent walter william"
)
SURNAMES = words(
    "agarwal ahuja banerjee bhatt bose chakraborty chatterjee chauhan chawla das desai deshmukh dutta ghosh goswami gupta iyer jain jha joshi kapoor kaur khanna kulkarni mahajan malhotra mehta menon mishra mukherjee nair "
    "naidu pandey patel pillai rao rathore reddy saxena sen shah sharma shetty singh sinha trivedi varma verma "
    "adams allen anderson armstrong bailey barnes bell bennett brooks brown campbell carter clark collins cooper cox davies edwards ellis evans fisher fletcher foster graham griffiths hall hamilton harris harrison hughes "
    "hunt jackson jenkins johnson jones kennedy king knight lawson lewis marshall mason miller mitchell moore morgan morris murphy nelson palmer parker phillips porter powell reed reynolds richardson roberts robinson "
    "russell saunders shaw simpson smith spencer stewart sullivan taylor thompson turner walker ward watson webb wells white williams wilson wood wright young"
)
NAME_WORDS = GIVEN_NAMES | SURNAMES

# ---- places

#: States and territories. Fixed values.
STATES = phrases(
    "andhra pradesh, arunachal pradesh, assam, bihar, chandigarh, chhattisgarh, delhi, goa, gujarat, haryana, himachal pradesh, jammu and kashmir, jharkhand, karnataka, kerala, ladakh, madhya pradesh, maharashtra, manipur, "
    "meghalaya, mizoram, nagaland, new delhi, odisha, puducherry, punjab, rajasthan, sikkim, tamil nadu, telangana, tripura, uttar pradesh, uttarakhand, west bengal"
)
#: Postal abbreviations. Fixed values.
US_STATES = words("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY")
#: Parts of postal addresses.
ADDRESS_WORDS = words(
    "alley apartment apartments avenue bazaar block boulevard building bungalow bypass chambers chowk circle close colony complex court crescent cross district drive enclave estate extension flat floor gali garden gardens "
    "gate ghat heights highway hill house lane layout marg market mews mill mohalla nagar park parade parkway peth place plaza plot quarters road row sector society square station street suite taluka tehsil terrace tower "
    "towers township vihar village ward way wing"
)
#: Besides those: what only shows that a line is part of an address.
ADDRESS_HINTS = words("apt ave behind blvd campus dist level near opp opposite post rd residency st tal")
#: Words that stand before six digits and aren't towns.
NOT_TOWNS = words("about account amount approximately clause code crore fiscal form invoice item lakh model no note number order page part plot policy ref room rs rule schedule section serial step table ticket total unit units version year")

# ---- ordinary English, for names that are only words. Stems are tried too.

DICTIONARY = words(
    "able add air allot animal answer apple ask bag ball base basis beach bear bed bell bird black blue board boat body bond book bottle box branch bread bridge bright build business buy call camera camp car card care carry "
    "cat chain change cheap child choice circle clean clear clock cloud coat coffee cold colour connect cook corner cost cotton count cover craft cream cross crown cup cut dance dark deal deep deliver design desk direct "
    "discover dog door double draw dream dress drink drive early earth easy edge egg engine enter equal even express face fair fall farm fast feed field fight final find fire fish flat flow flower fly fold food foot forest "
    "free fresh fruit full game garden gate gift glass gold good grain grand grass great green ground grow guard hand happy hard heart heavy high hill hold hope horse hot image island join jump keep kind kitchen lake lamp land "
    "large lead leaf learn letter light lion list load lock long look lunch machine mail market match meal measure meet metal milk mind mirror moon mountain move music need net night noise nose ocean oil open option orange"
)

# ---- made-up parts of fakes

ORG_DESCRIPTORS = ("Amber", "Birch", "Cedar", "Copper", "Falcon", "Granite", "Indigo", "Maple", "Opal", "Raven", "Saffron", "Velvet")
STREETS = ("Acacia Street", "Bluebell Lane", "Canal Road", "Dovecote Avenue", "Elm Park Road", "Foundry Street", "Granary Lane", "Heron Way", "Ivy Terrace", "Juniper Road")
CITIES = ("Amarvati Nagar", "Bhanupur", "Chitralok", "Dhavalgiri", "Ekampur", "Falgunabad", "Girijapur", "Hemkunj")

# ---- identity cards

#: What is printed on them. Fixed values.
ID_CUES = phrases(
    "income tax department, permanent account number, government of india, election commission, driving licence, aadhaar, unique identification, passport, date of birth, father's name, identity card, voter, आधार, भारत सरकार, जन्म, पहचान"
)
ID_LABELS = {
    "name": phrases("name, नाम"), "father": phrases("father, father's, पिता"), "dob": phrases("dob, birth, जन्म"), "address": phrases("address, पता"), "signature": phrases("signature, हस्ताक्षर"),
}


def is_title(phrase: str) -> bool:
    """Whether a phrase, in lower case, is a job title or several."""
    parts = phrase.replace(",", " ").split()
    return bool(parts) and parts[-1] in TITLE_HEADS and all(x in TITLE_HEADS or x in TITLE_MODIFIERS or x == "and" for x in parts)


@dataclass(frozen=True)
class RunConfig:
    """Options of a run. ``scope``: 'document' or 'corpus', within which one value has one fake."""

    seed: int = 42
    scope: str = "document"
    entities: tuple[str, ...] = tuple(PRIORITY)
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    default_threshold: float = DEFAULT_THRESHOLD
    write_mapping: bool = False
    pad: int = 4

    def threshold(self, entity: str) -> float:
        return self.thresholds.get(ALIASES.get(entity, entity), self.default_threshold)
