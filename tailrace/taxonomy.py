"""The label taxonomy and the other fixed values of the domain."""

# fixed values: the order is the label's index
LABELS = (
    "config-change",
    "retry-storm",
    "cascading-failure",
    "dns",
    "certificate-expiry",
    "capacity-exhaustion",
    "bad-deploy",
    "dependency-failure",
    "network-partition",
    "database-failure",
    "thundering-herd",
    "monitoring-gap",
    "human-error",
    "data-corruption",
    "quota-limit",
)

# fixed value: an annotator looked at the incident and chose no label
REVIEWED = "__reviewed__"

# fixed values: one pattern per label, in the order of the labels; matched without regard to case
KEYWORDS = (
    ("config-change", r"(?:mis)?config(?:uration)?[\s\-](?:change|error|update|flag|wrong|incorrect)|feature[\s\-]?flag.*(?:wrong|incorrect|misconfigured)|environment[\s\-]?variable.*(?:wrong|incorrect|missing)|config(?:uration)?.*(?:caused|triggered|resulted)"),
    ("retry-storm", r"retry[\s\-]?(?:storm|amplif|flood|loop|avalanche)|(?:amplif|storm|thunder).*retr(?:y|ied|ies)|retr(?:y|ied|ies).*(?:overwhelm|flood|amplif|exacerbat)|exponential.*retr(?:y|ies).*(?:no|without|missing).*backoff"),
    ("cascading-failure", r"cascad(?:e|ing)[\s\-]?fail|failure.*propagat|(?:chain|domino)[\s\-]?(?:of[\s\-]?)?fail|(?:upstream|downstream).*fail.*(?:caused|led|result)|thread[\s\-]?pool.*exhaust.*(?:propagat|spread|upstream)"),
    ("dns", r"dns[\s\-]?(?:resol|lookup|failure|timeout|propagat|outage|misconfigur|issue)|(?:cname|zone[\s\-]?file|zone[\s\-]?transfer|name[\s\-]?server).*(?:fail|error|wrong)|(?:resol|lookup).*(?:fail|timeout).*(?:dns|domain|hostname)|dns[\s\-]?record"),
    ("certificate-expiry", r"certif(?:icate)?.*(?:expir|invalid|mismatch|chain|renew)|(?:tls|ssl|https?).*(?:expir|invalid|mismatch)|expir.*certif|(?:x509|pkix|certificate[\s\-]?chain).*(?:error|fail|invalid)"),
    ("capacity-exhaustion", r"(?:disk|storage|memory|cpu|connection[\s\-]?pool|file[\s\-]?descriptor).*(?:exhaust|full|limit|saturat|ran[\s\-]?out|oom|out[\s\-]?of)|out[\s\-]?of[\s\-]?(?:memory|disk|space|capacity)|oom[\s\-]?(?:kill|error)|(?:auto[\s\-]?scal|scale[\s\-]?(?:up|out)).*(?:fail|unable|too[\s\-]?slow)"),
    ("bad-deploy", r"(?:deploy|release|rollout|push).*(?:caus|trigger|introduc|contain|had).*(?:bug|regression|error|issue|failure)|roll(?:back|ing[\s\-]?back).*(?:resolv|fix|mitigat|restor)|(?:canary|blue[\s\-]?green|rolling).*(?:fail|bad|broke)|bad[\s\-]?(?:deploy|release|push|build)"),
    ("dependency-failure", r"(?:aws|gcp|azure|cloud[\s\-]?provider|third[\s\-]?party|external|upstream[\s\-]?service).*(?:outage|down|unavail|fail|error|degrad)|(?:outage|failure).*(?:aws|gcp|azure|cloud[\s\-]?provider|third[\s\-]?party)|(?:s3|ec2|rds|lambda|dynamo|cloudfront|route[\s\-]?53).*(?:outage|fail|unavail)"),
    ("network-partition", r"network[\s\-]?partition|split[\s\-]?brain|bgp.*(?:misconfigur|error|leak|hijack)|(?:vpc|subnet|security[\s\-]?group|firewall).*(?:block|reject|deny|misconfigur)|packet[\s\-]?(?:loss|drop).*(?:significan|major|complet)"),
    ("database-failure", r"(?:database|db|postgres|mysql|mongo|redis|cassandra)[\s\-]?(?:fail|crash|deadlock|lock[\s\-]?contention|replication[\s\-]?lag|failover|corrupt)|(?:deadlock|lock[\s\-]?contention|replication[\s\-]?lag).*(?:database|db)|(?:primary|master|leader)[\s\-]?(?:database|db).*fail|failover.*(?:database|db|replica)"),
    ("thundering-herd", r"thunder(?:ing)?[\s\-]?herd|cache[\s\-]?(?:stampede|avalanche|thundering)|(?:cold[\s\-]?cache|cache[\s\-]?miss).*(?:overwhelm|flood|spike)|(?:simultaneous|all[\s\-]?at[\s\-]?once).*(?:reconnect|request|query).*(?:overwhelm|flood)"),
    ("monitoring-gap", r"no[\s\-]?(?:alert|monitor|dashboard|metric|observ)|(?:alert|monitor|dashboard|metric).*(?:missing|absent|didn.t[\s\-]?exist|not[\s\-]?set[\s\-]?up)|(?:detect|discover).*(?:hours?|days?)[\s\-]?later|lack(?:ed)?[\s\-]?(?:of[\s\-]?)?(?:monitor|alert|observ|visib)"),
    ("human-error", r"human[\s\-]?error|(?:operator|engineer|admin|sre|developer).*(?:accident|mistake|wrong|incorrect|inadvert)|(?:ran|executed|typed|entered).*(?:wrong|incorrect|production[\s\-]?instead)|(?:manual|accidentally).*(?:delet|drop|remov|kill|terminat)"),
    ("data-corruption", r"data[\s\-]?(?:corrupt|loss|integrity|inconsisten)|(?:corrupt|lost|missing|inconsistent)[\s\-]?data|(?:race[\s\-]?condition|write[\s\-]?conflict).*(?:corrupt|overwr|inconsisten)|silent(?:ly)?[\s\-]?(?:corrupt|drop|truncat|overwr)"),
    ("quota-limit", r"(?:rate|api)[\s\-]?limit.*(?:hit|reach|exceed|block|throttl)|(?:quota|usage[\s\-]?cap|usage[\s\-]?limit).*(?:hit|reach|exceed)|429.*(?:too[\s\-]?many|rate[\s\-]?limit|throttl)|(?:instance|resource)[\s\-]?limit.*(?:prevent|block|unable)"),
)
