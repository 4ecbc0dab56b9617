"""What recognition makes of words, as (pattern, replacement), applied in this order."""

CONFUSIONS = [
    (r"\bThls\b", r"This"),
    (r"\bthls\b", r"this"),
    (r"\bsublecl\b", r"subject"),
    (r"\bcondillon\b", r"condition"),
    (r"\bcondillons\b", r"conditions"),
    (r"\bthal\b", r"that"),
    (r"\bil\b", r"it"),
    (r"\bnol\b", r"not"),
    (r"\{ho\b", r"the"),
    (r"\blo\b", r"to"),
    (r"\bwhlch\b", r"which"),
    (r"\bwilh\b", r"with"),
    (r"\bElforn\b", r"Ellora"),
    (r"\bTempte\b", r"Temple"),
    (r"\baud\b", r"and"),
    (r"\bAud\b", r"And"),
    (r"\bThiugs\b", r"Things"),
    (r"\bthiugs\b", r"things"),
    (r"\bPreachiug\b", r"Preaching"),
    (r"\bpreachiug\b", r"preaching"),
    (r"\bfiņd\b", r"find"),
    (r"\bTne\b", r"The"),
    (r"\bI'he\b", r"The"),
    (r"\beaste['']?n\b", r"eastern"),
    (r"\brnle\b", r"rule"),
    (r"\bFhe\b", r"The"),
    (r"\bgrealust\b", r"greatest"),
    (r"\bsurious\b", r"serious"),
    (r"\bsurhus\b", r"serious"),
    (r"\bmeanirig\b", r"meaning"),
    (r"\bterins\b", r"terms"),
    (r"\bSyslem\b", r"System"),
    (r"\bfoumndations\b", r"foundations"),
    (r"\bfoumndatios\b", r"foundations"),
    (r"\bHinduslan\b", r"Hindustan"),
    (r"\bHíndu\b", r"Hindu"),
    (r"\bÍndia\b", r"India"),
    (r"\bgrulling\b", r"gruelling"),
    (r"\bGrulling\b", r"Gruelling"),
    (r"\bplebianize\b", r"plebeianize"),
    (r"\bPlebianize\b", r"Plebeianize"),
    (r"\bKesselschlact\b", r"Kesselschlacht"),
    (r"\bkesselschlact\b", r"kesselschlacht"),
    (r"\bSull[- ]k[iu]tl?\b", r"Sulh-kul"),
    (r"\bentrused\b", r"entrusted"),
    (r"\breligon\b", r"religion"),
    (r"\bunifed\b", r"unified"),
    (r"\bcial\b", r"social"),
    (r"SOCIAL SCIENCE PART 1 SOCIAL SCIENCE - PART 1", r"SOCIAL SCIENCE - PART I"),
    (r"SOCIAL SCIENCE - PART 1 SOCIAL SCIENCE - PART 1", r"SOCIAL SCIENCE - PART I"),
    (r"\bmonotheistsant\b", r"monotheist saint"),
    (r"\bMonotheistsant\b", r"Monotheist Saint"),
    (r"\bSikhismsant\b", r"Sikhism saint"),
    (r"\bHindusiant\b", r"Hindu saint"),
    (r"\bBhaktisant\b", r"Bhakti saint"),
    (r"\bgurubhakti\b", r"guru bhakti"),
    (r"\bGurubhakti\b", r"Guru Bhakti"),
    (r"\bRajputstate\b", r"Rajput state"),
    (r"\brajputstate\b", r"Rajput state"),
    (r"\bMughalcourt\b", r"Mughal court"),
    (r"\bmughalcourt\b", r"Mughal court"),
    (r"\bMughalempire\b", r"Mughal Empire"),
    (r"\bmughalempire\b", r"Mughal Empire"),
    (r"\bInbrceding\b", r"Inbreeding"),
    (r"\binbrceding\b", r"inbreeding"),
    (r"\bMeasurcments\b", r"Measurements"),
    (r"\bmeasurcments\b", r"measurements"),
    (r"\bCollcction\b", r"Collection"),
    (r"\bcollcction\b", r"collection"),
    (r"\bComposd\b", r"Composed"),
    (r"\bPrintcd\b", r"Printed"),
    (r"\bGrcatcr\b", r"Greater"),
    (r"\bgrcatcr\b", r"greater"),
    (r"\bDclhi\b", r"Delhi"),
    (r"\bPhasc-Il\b", r"Phase-II"),
    (r"\bPhasc\b", r"Phase"),
    (r"\bLathccf\b", r"Latheef"),
    (r"\blathccf\b", r"latheef"),
    (r"\bshas\s+defined\b", r"has defined"),
    (r"\bdealswith\b", r"deals with"),
    (r"\bDealswith\b", r"Deals with"),
    (r"\bNew\s+Dehi\b", r"New Delhi"),
    (r"\bnew\s+dehi\b", r"new delhi"),
    (r"\bhominds\b", r"hominids"),
    (r"\bpopulatoin\b", r"population"),
    (r"\bPopulatoin\b", r"Population"),
    (r"\bvariaiton\b", r"variation"),
    (r"\bVariaiton\b", r"Variation"),
    (r"\bvariaitons\b", r"variations"),
    (r"\bVariaitons\b", r"Variations"),
    (r"\banthroplogical\b", r"anthropological"),
    (r"\bAnthroplogical\b", r"Anthropological"),
    (r"\banthroplogist\b", r"anthropologist"),
    (r"\bAnthroplogist\b", r"Anthropologist"),
    (r"\banthroplogists\b", r"anthropologists"),
    (r"\bAnthroplogists\b", r"Anthropologists"),
    (r"\banthroplogic\b", r"anthropologic"),
    (r"\bphysicai\b", r"physical"),
    (r"\bPhysicai\b", r"Physical"),
    (r"\bbiologicai\b", r"biological"),
    (r"\bBiologicai\b", r"Biological"),
    (r"\bcuitural\b", r"cultural"),
    (r"\bCuitural\b", r"Cultural"),
    (r"\bsoicety\b", r"society"),
    (r"\bSoicety\b", r"Society"),
    (r"\bsoicetal\b", r"societal"),
    (r"\bSoicetal\b", r"Societal"),
    (r"\bkinshp\b", r"kinship"),
    (r"\bKinshp\b", r"Kinship"),
    (r"\bmarraiage\b", r"marriage"),
    (r"\bMarraiage\b", r"Marriage"),
    (r"\bmarraiages\b", r"marriages"),
    (r"\bdescnt\b", r"descent"),
    (r"\bDescnt\b", r"Descent"),
    (r"\blineaage\b", r"lineage"),
    (r"\bLineaage\b", r"Lineage"),
    (r"\blineaages\b", r"lineages"),
    (r"\btribal\s+socites\b", r"tribal societies"),
    (r"\bTribal\s+Socites\b", r"Tribal Societies"),
    (r"\bethnicty\b", r"ethnicity"),
    (r"\bEthnicty\b", r"Ethnicity"),
    (r"\bethnogarphy\b", r"ethnography"),
    (r"\bEthnogarphy\b", r"Ethnography"),
    (r"\bethnogarphic\b", r"ethnographic"),
    (r"\banthropoogy\b", r"anthropology"),
    (r"\bAnthropoogy\b", r"Anthropology"),
    (r"\bsocio-cultual\b", r"socio-cultural"),
    (r"\bSocio-Cultual\b", r"Socio-Cultural"),
    (r"\bsociocultual\b", r"sociocultural"),
    (r"\bpastoralsim\b", r"pastoralism"),
    (r"\bPastoralsim\b", r"Pastoralism"),
    (r"\bnomadsim\b", r"nomadism"),
    (r"\bNomadsim\b", r"Nomadism"),
    (r"\bpeasnatry\b", r"peasantry"),
    (r"\bPeasnatry\b", r"Peasantry"),
    (r"\bfunctionailsm\b", r"functionalism"),
    (r"\bFunctionailsm\b", r"Functionalism"),
    (r"\bstructurailsm\b", r"structuralism"),
    (r"\bStructurailsm\b", r"Structuralism"),
    (r"\bsymobl\b", r"symbol"),
    (r"\bSymobl\b", r"Symbol"),
    (r"\bsymobls\b", r"symbols"),
    (r"\brituai\b", r"ritual"),
    (r"\bRituai\b", r"Ritual"),
    (r"\brituais\b", r"rituals"),
    (r"\bsymbosim\b", r"symbolism"),
    (r"\bSymbosim\b", r"Symbolism"),
    (r"\btotemisn\b", r"totemism"),
    (r"\bTotemisn\b", r"Totemism"),
    (r"\banimisn\b", r"animism"),
    (r"\bAnimisn\b", r"Animism"),
]
