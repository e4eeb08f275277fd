"""Domain packs as data: rules, kinds, predicates, aliases, sentence forms, risks and messages. A further domain is further rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHOP, CULTURE, LOAN, GENERIC, ENGLISH = "ecommerce_cs", "corporate_culture", "loan_finance", "generic", "english"
#: Stands for the text that the group `product` of a rule matches.
PRODUCT = "{product}"

# The rules of each pack in order, as subject, predicate and pattern with the group `object`; what they match is their definition.
_RETURN, _THIS = "七天无理由", "本产品"
_LOAN_NAME = r"(?P<product>个人(?:综合)?消费贷款|个人信用贷款|住房贷款|经营贷款|[^\s，。；;：:\n]{2,20}(?:贷款|贷))"
RULES = {
    SHOP: [
        (_RETURN, "适用类目", r"七[日天]无理由(?:退货)?适用(?:类目|范围|商品)为(?P<object>[^。；;\n]+)"),
        (_RETURN, "适用类目", r"(?P<object>非定制商品|普通商品)(?:适用|可申请)七[日天]无理由(?:退货)?"),
        (_RETURN, "适用类目", r"七[日天]无理由(?:退货)?适用于(?P<object>[^。；;\n]+)"),
        (_RETURN, "排除", r"(?P<object>定制商品|定作商品|消费者定作的商品|鲜活易腐(?:的商品)?|数字化商品|音像制品|计算机软件|报纸|期刊)不适用七[日天]无理由(?:退货)?"),
        (_RETURN, "排除", r"(?:下列|以下)?商品不适用七日?无理由退货[：:]\s*(?P<object>[^。\n]+)"),
        (_RETURN, "排除", r"七[日天]无理由(?:退货)?不适用于?(?P<object>定制商品|定作商品|鲜活易腐|数字化商品|报纸|期刊|[^。；;\n]{2,30})"),
        (_RETURN, "排除", r"(?P<object>定制商品|定作商品)不支持(?:七[日天])?无理由退货"),
        (_RETURN, "排除", r"经消费者(?:在购买时)?确认(?:后)?(?:可以)?不适用七日?无理由退货[的]?(?:商品)?[：:]?\s*(?P<object>[^。\n]+)"),
        (_RETURN, "运费承担方", r"七[日天]无理由退货运费(?:由|承担方为)(?P<object>[^。；;\n]+)"),
        (_RETURN, "运费承担方", r"商品退回(?:所产生)?的运费(?:依法)?由(?P<object>[^。；;\n]+)承担"),
        (_RETURN, "运费承担方", r"(?:无理由)?退货(?:的)?运费由(?P<object>买家|卖家|商家|经营者|消费者|平台)承担"),
        (_RETURN, "运费承担方", r"运费承担方为(?P<object>买家|卖家|商家|经营者|消费者|平台)"),
        (_RETURN, "运费承担方", r"(?:质量问题|商品质量问题|不符合质量要求)退货(?:运费)?由(?P<object>商家|卖家|经营者)承担"),
        (_RETURN, "退货时限_天", r"(?:自收到商品之日起|确认收货后|签收后)\s*(?P<object>\d+)\s*日(?:内)?(?:可|可以)?(?:申请)?(?:七天|七日)?无理由退货"),
        (_RETURN, "退货时限_天", r"七[日天]无理由退货时限为(?P<object>\d+)\s*天"),
        (_RETURN, "退货时限_天", r"(?:退货|无理由退货)期限为?(?P<object>\d+)\s*[日天]"),
        (_RETURN, "退货时限_天", r"(?P<object>7|七)\s*[日天]内(?:可|可以)?(?:申请)?无理由退货"),
        (_RETURN, "需包装完好", r"退回的商品应当(?P<object>完好)"),
        (_RETURN, "需包装完好", r"需(?:要)?(?P<object>包装完好|商品完好)"),
        (_RETURN, "需包装完好", r"商品应(?:当)?保持(?P<object>完好)"),
        (_RETURN, "需包装完好", r"商品完好(?:标准)?(?:是指|为)(?P<object>[^。；;\n]+)"),
        (_RETURN, "需包装完好", r"(?:退货时|申请退货时)?商品(?:须|应|应当)(?P<object>完好无损|保持完好)"),
        (_RETURN, "是否支持无理由退货", r"(?P<object>支持)七[日天]无理由(?:退货)?"),
        (_RETURN, "是否支持无理由退货", r"(?P<object>不支持)(?:七[日天])?无理由退货"),
        (_RETURN, "是否支持无理由退货", r"是否支持无理由退货[：:]\s*(?P<object>是|否|支持|不支持)"),
    ],
    CULTURE: [
        ("员工手册", "倡导", r"员工手册倡导(?P<object>[^。；;\n]+)"),
        ("行为准则", "倡导", r"行为准则倡导(?P<object>[^。；;\n]+)"),
        ("公司", "倡导", r"(?:公司|本手册|本准则|本指南)倡导(?P<object>[^。；;\n]+)"),
        ("公司", "倡导", r"倡导员工(?P<object>[^。；;\n]+)"),
        ("公司", "倡导", r"鼓励(?:员工)?(?P<object>诚信|协作|举报|相互尊重|[^。；;\n]{2,30})"),
        ("诚信", "倡导", r"诚信倡导(?P<object>[^。；;\n]+)"),
        ("公司", "倡导", r"(?:坚持|营造|践行)(?P<object>廉洁诚信|诚信合规|尊重包容|协作创新)(?:的)?"),
        ("员工手册", "禁止", r"员工手册禁止(?P<object>[^。；;\n]+)"),
        ("行为准则", "禁止", r"行为准则禁止(?P<object>[^。；;\n]+)"),
        ("员工手册", "禁止", r"(?:严禁|禁止)(?P<object>贿赂|回扣|腐败|利益冲突|歧视|骚扰|泄密|虚假记录|内幕交易|打击报复|侵占(?:公司)?财产|[^。；;\n]{2,40})"),
        ("员工手册", "禁止", r"不得(?P<object>从事任何形式的歧视|泄露(?:公司)?保密信息|索取或接受(?:金钱|礼物|利益)|将(?:公司)?保密信息[^。；;\n]{0,20})"),
        ("员工手册", "禁止", r"反对(?P<object>歧视|骚扰|任何歧视|任何形式的歧视[^。；;\n]*)"),
        ("员工手册", "禁止", r"严格禁止对(?P<object>举报人(?:或参与调查人员)?[^。；;\n]*)"),
        ("员工手册", "适用于", r"(?:员工手册|行为准则|本手册|本准则|本指南)适用于(?P<object>[^。；;\n]+)"),
        ("员工手册", "适用于", r"适用范围[：:]\s*(?P<object>[^。；;\n]+)"),
        ("行为准则", "适用于", r"准则适用于(?P<object>[^。；;\n]+)"),
    ],
    LOAN: [
        (PRODUCT, "最高额度", _LOAN_NAME + r"(?:的)?最高额度(?:为|可达|不超过|最高)?(?P<object>[^。；;\n]+)"),
        (_THIS, "最高额度", r"最高额度(?:可达|为|不超过)\s*(?P<object>\d+(?:\.\d+)?\s*万?元?)"),
        (_THIS, "最高额度", r"(?:单户)?贷款(?:金额|额度)不超过(?P<object>[^。；;\n]+)"),
        (_THIS, "最高额度", r"最高授信\s*(?P<object>\d+\s*万)"),
        (_THIS, "最高额度", r"授信额度(?:最高)?(?:为|可达|不超过)?(?P<object>\d+(?:\.\d+)?\s*万?元?)"),
        (_THIS, "最高额度", r"额度上限(?:为|：|:)?\s*(?P<object>\d+(?:\.\d+)?\s*万?元?)"),
        (PRODUCT, "利率_年化", _LOAN_NAME + r"(?:年化)?利率(?:为|约|低至|起)?(?P<object>[^。；;\n]+)"),
        (_THIS, "利率_年化", r"年化利率(?:为|约|低至|起)?(?P<object>[^。；;\n%]*%?(?:起|－|-|~|至)[^。；;\n]*)"),
        (_THIS, "利率_年化", r"年化利率(?:为|约|低至|起)?(?P<object>\d+(?:\.\d+)?%\s*(?:起)?)"),
        (_THIS, "利率_年化", r"年化综合融资成本(?:为|：|:)?\s*(?P<object>[^。；;\n]+)"),
        (_THIS, "利率_年化", r"贷款利率(?:按照|按)(?P<object>[^。；;\n]+)"),
        (PRODUCT, "还款方式", _LOAN_NAME + r"还款方式(?:为|包括|支持|：|:)?(?P<object>[^。；;\n]+)"),
        (_THIS, "还款方式", r"还款方式(?:为|包括|支持|：|:)?(?P<object>等额本息|等额本金|先息后本|随借随还|到期一次还本付息|按期付息任意还本|[^。；;\n]+)"),
        (_THIS, "还款方式", r"(?:可选择|可选|采用)(?P<object>按月等额本息|按月等额本金|等额本息|等额本金|先息后本|随借随还)(?:等)?(?:还款方式)?"),
        (PRODUCT, "适用客户", _LOAN_NAME + r"适用(?:于)?客户(?P<object>[^。；;\n]+)"),
        (_THIS, "适用客户", r"贷款对象[：:]\s*(?P<object>[^。；;\n]+)"),
        (_THIS, "适用客户", r"适用(?:于)?(?:有(?:消费)?融资需求[，,]?)?(?P<object>年满\s*\d+\s*周岁[^。；;\n]*)"),
        (_THIS, "适用客户", r"适用于(?P<object>有消费融资需求[^。；;\n]*)"),
        (PRODUCT, "贷款期限", _LOAN_NAME + r"(?:贷款)?期限(?:最长)?(?:不超过|为)?(?P<object>[^。；;\n]+)"),
        (_THIS, "贷款期限", r"(?:贷款)?期限最长不超过(?P<object>[^。；;\n]+)"),
        (_THIS, "贷款期限", r"授信期限最长不超过(?P<object>[^。；;\n]+)"),
        (_THIS, "贷款期限", r"贷款期限(?:为|：|:)?\s*(?P<object>\d+\s*年(?:以内|（含）以内)?[^。；;\n]*)"),
        (PRODUCT, "担保方式", _LOAN_NAME + r"担保方式(?:为|采取|包括)?(?P<object>[^。；;\n]+)"),
        (_THIS, "担保方式", r"担保方式(?:为|采取|包括)(?P<object>信用|抵押|质押|保证|[^。；;\n]+)"),
        (_THIS, "担保方式", r"采取(?P<object>抵押、保证、信用|信用、抵押|抵押|保证|质押|信用)方式"),
        (_THIS, "担保方式", r"采用(?P<object>信用)方式"),
        (PRODUCT, "贷款用途", _LOAN_NAME + r"(?:可用于|用于)(?P<object>[^。；;\n]+)"),
        (_THIS, "贷款用途", r"贷款用途[：:]\s*(?P<object>[^。；;\n]+)"),
        (_THIS, "贷款用途", r"(?:必须有明确的消费用途|可用于)(?P<object>[^。；;\n]+)"),
        (_THIS, "贷款用途", r"不得用于(?P<object>[^。；;\n]+)"),
        (_THIS, "起息说明", r"起息(?:日|说明)?[：:]\s*(?P<object>[^。；;\n]+)"),
        (_THIS, "起息说明", r"(?:自|从)(?P<object>贷款发放日|放款日|资金到账日)(?:起)?(?:开始)?计息"),
        (_THIS, "起息说明", r"贷款划出日即为(?:实际)?贷款发放日[，,]?(?P<object>[^。；;\n]*)"),
    ],
    GENERIC: [],
    ENGLISH: [
        ("license", "granted_under", r"(?:Licensed|Released) under (?:the )?(?P<object>[^\n]+)"),
        ("contact", "has_email", r"(?P<object>[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9])"),
        (PRODUCT, "under", r"under (?:the )?(?P<object>(?P<product>[A-Z][A-Za-z]+)[^\n]*)"),
    ],
}
CONFIDENCE = {SHOP: 0.9, CULTURE: 0.9, LOAN: 0.88, GENERIC: 0.9, ENGLISH: 0.9}

# Sentence forms of claims by pack and predicate ({s}: subject, {o}: object; otherwise subject, predicate, object), predicates of
# high risk, and what is said where nothing is known well enough.
FORMS = [
    (SHOP, "排除", "{o}不适用{s}"),
    (SHOP, "适用类目", "{s}适用类目为{o}"),
    (SHOP, "运费承担方", "{s}运费承担方为{o}"),
    (SHOP, "退货时限_天", "{s}退货时限为{o}天"),
    (SHOP, "需包装完好", "{s}要求{o}"),
    (SHOP, "是否支持无理由退货", "{s}{o}无理由退货"),
    (LOAN, "利率_年化", "{s}年化利率为{o}"),
    (LOAN, "最高额度", "{s}最高额度为{o}"),
    (LOAN, "还款方式", "{s}还款方式为{o}"),
    (LOAN, "适用客户", "{s}适用于{o}"),
    (LOAN, "贷款期限", "{s}贷款期限为{o}"),
    (LOAN, "担保方式", "{s}担保方式为{o}"),
    (LOAN, "贷款用途", "{s}贷款用途为{o}"),
    (LOAN, "起息说明", "{s}起息说明：{o}"),
    (ENGLISH, "granted_under", "The {s} is granted under {o}"),
]
RISKS = [(CULTURE, "禁止"), (LOAN, "利率_年化"), (LOAN, "最高额度"), (LOAN, "适用客户"), (SHOP, "运费承担方"), (SHOP, "退货时限_天"), (SHOP, "排除")]
MESSAGE = "依据不足，无法根据现有知识库内容回答该问题。"
PREDICATES = [
    (SHOP, "RefundRule", "适用类目", "Category"),
    (SHOP, "RefundRule", "排除", "Category"),
    (SHOP, "RefundRule", "退货时限_天", "Concept"),
    (SHOP, "RefundRule", "运费承担方", "Concept"),
    (SHOP, "RefundRule", "需包装完好", "Concept"),
    (SHOP, "RefundRule", "是否支持无理由退货", "Concept"),
    (SHOP, "Policy", "引用", "RefundRule"),
    (SHOP, "Policy", "覆盖", "Policy"),
    (SHOP, "ShippingRule", "适用", "Category"),
    (SHOP, "ShippingRule", "优先于", "ShippingRule"),
    (CULTURE, "Value", "倡导", "Behavior"),
    (CULTURE, "Value", "倡导", "Value"),
    (CULTURE, "Policy", "倡导", "Value"),
    (CULTURE, "Policy", "倡导", "Behavior"),
    (CULTURE, "Policy", "禁止", "Behavior"),
    (CULTURE, "Policy", "适用于", "Department"),
    (CULTURE, "Policy", "适用于", "Behavior"),
    (CULTURE, "Concept", "倡导", "Concept"),
    (LOAN, "Product", "适用客户", "Concept"),
    (LOAN, "Product", "利率_年化", "Concept"),
    (LOAN, "Product", "最高额度", "Concept"),
    (LOAN, "Product", "还款方式", "RepaymentMethod"),
    (LOAN, "Product", "贷款期限", "Concept"),
    (LOAN, "Product", "担保方式", "GuaranteeType"),
    (LOAN, "Product", "贷款用途", "Concept"),
    (LOAN, "Product", "起息说明", "Concept"),
    (GENERIC, "Concept", "相关", "Concept"),
    (GENERIC, "Concept", "定义", "Concept"),
    (GENERIC, "Concept", "属于", "Concept"),
    (GENERIC, "Policy", "规定", "Concept"),
    (GENERIC, "Policy", "适用于", "Concept"),
    (GENERIC, "Policy", "禁止", "Concept"),
    (GENERIC, "Policy", "要求", "Concept"),
]
ALIASES = [
    (SHOP, "7天无理由", "七天无理由"),
    (SHOP, "七日无理由", "七天无理由"),
    (SHOP, "七天无理由退货", "七天无理由"),
    (SHOP, "无理由退货", "七天无理由"),
    (SHOP, "定作的商品", "定作商品"),
    (SHOP, "消费者定作的商品", "定作商品"),
    (SHOP, "鲜活易腐的商品", "鲜活易腐"),
    (CULTURE, "价值观", "诚信"),
    (CULTURE, "文化手册", "员工手册"),
    (CULTURE, "行为规范", "行为准则"),
    (LOAN, "消费贷", "个人消费贷款"),
    (LOAN, "信用贷", "个人信用贷款"),
    (LOAN, "房贷", "住房贷款"),
    (LOAN, "年化利率", "利率_年化"),
    (LOAN, "额度上限", "最高额度"),
]


def rules(spark: SparkSession) -> DataFrame:
    """pack, ord, subject, predicate, pattern, confidence."""
    rows = [(pack, i, *rule, CONFIDENCE[pack]) for pack, own in RULES.items() for i, rule in enumerate(own)]
    return spark.createDataFrame(rows, "pack string, ord int, subject string, predicate string, pattern string, confidence double")


def predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREDICATES, "pack string, subject_type string, predicate string, object_type string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "pack string, alias string, canonical string")


def forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMS, "pack string, predicate string, form string")


def risks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RISKS, "pack string, predicate string")
