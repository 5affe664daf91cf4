"""The built-in rules hold every entry of the catalogs they must hold."""

from loomgraph.sources import rules

#: Entries that were not there once.
ADDED = """
sink deserialize com/thoughtworks/xstream/XStream#fromXML
sink deserialize com/alibaba/fastjson/JSON#parseObject
sink deserialize com/alibaba/fastjson/JSON#parse
sink deserialize com/alibaba/fastjson2/JSON#parseObject
sink reflect java/lang/Class#newInstance
sink reflect java/lang/reflect/Constructor#newInstance
sink jndi javax/naming/directory/InitialDirContext#lookup
sink sql java/sql/Statement#executeLargeUpdate
sink file java/io/RandomAccessFile#<init>
sink file java/nio/file/Files#readAllBytes
sink ssrf org/apache/http/client/HttpClient#execute
sink expr java/lang/reflect/Method#invoke
sink expr ognl/Ognl#getValue
sink xxe javax/xml/stream/XMLInputFactory#createXMLStreamReader
sink xxe org/dom4j/io/SAXReader#read
source http javax/servlet/http/HttpServletRequest#getParameterValues
source http javax/servlet/http/HttpServletRequest#getParameterMap
source http javax/servlet/http/HttpServletRequest#getParameterNames
source http javax/servlet/http/HttpServletRequest#getHeaders
source http javax/servlet/http/HttpServletRequest#getInputStream
source http javax/servlet/http/HttpServletRequest#getReader
source http javax/servlet/http/HttpServletRequest#getRequestURL
source http jakarta/servlet/http/HttpServletRequest#getParameter
source http jakarta/servlet/http/HttpServletRequest#getParameterValues
source http jakarta/servlet/http/HttpServletRequest#getParameterMap
source http jakarta/servlet/http/HttpServletRequest#getHeaders
source http jakarta/servlet/http/HttpServletRequest#getInputStream
source http jakarta/servlet/http/HttpServletRequest#getReader
source http jakarta/servlet/http/HttpServletRequest#getCookies
source net java/net/Socket#getInputStream
"""
SANITIZERS = """
org/apache/commons/lang3/StringEscapeUtils escapeHtml4 (Ljava/lang/String;)Ljava/lang/String; 0
org/apache/commons/lang3/StringEscapeUtils escapeXml (Ljava/lang/String;)Ljava/lang/String; 0
org/apache/commons/lang3/StringEscapeUtils escapeJava (Ljava/lang/String;)Ljava/lang/String; 0
org/springframework/web/util/HtmlUtils htmlEscape (Ljava/lang/String;)Ljava/lang/String; 0
org/springframework/web/util/HtmlUtils htmlEscapeDecimal (Ljava/lang/String;)Ljava/lang/String; 0
org/springframework/web/util/HtmlUtils htmlEscapeHex (Ljava/lang/String;)Ljava/lang/String; 0
java/sql/PreparedStatement setString (ILjava/lang/String;)V 1
java/sql/PreparedStatement setObject (ILjava/lang/Object;)V 1
java/util/regex/Pattern quote (Ljava/lang/String;)Ljava/lang/String; 0
org/owasp/esapi/ESAPI encoder ()Lorg/owasp/esapi/Encoder; 0
org/owasp/esapi/Encoder encodeForHTML (Ljava/lang/String;)Ljava/lang/String; 0
org/owasp/esapi/Encoder encodeForSQL (Lorg/owasp/esapi/codecs/Codec;Ljava/lang/String;)Ljava/lang/String; 1
org/owasp/esapi/Encoder encodeForJavaScript (Ljava/lang/String;)Ljava/lang/String; 0
org/owasp/esapi/Encoder encodeForURL (Ljava/lang/String;)Ljava/lang/String; 0
org/apache/commons/codec/digest/DigestUtils md5Hex (Ljava/lang/String;)Ljava/lang/String; 0
org/apache/commons/codec/digest/DigestUtils sha1Hex (Ljava/lang/String;)Ljava/lang/String; 0
org/apache/commons/validator/routines/EmailValidator isValid (Ljava/lang/String;)Z 0
org/apache/commons/validator/routines/UrlValidator isValid (Ljava/lang/String;)Z 0
"""


def catalog(text):
    return {tuple(x.split()) for x in text.splitlines() if x.strip() and not x.startswith("#")}


def sanitizers(found):
    return {(r["className"], r["methodName"], r["methodDesc"], str(r["paramIndex"])) for r in found}


def test_no_rule_is_missing(spark):
    found = {(r.kind, r.category, f"{r.owner}#{r.name}") for r in rules.read_rules(spark).collect()}
    assert catalog(ADDED) <= found
    assert len([x for x in found if x[0] == "sink"]) >= 48 and len([x for x in found if x[0] == "source"]) >= 23
    assert catalog(SANITIZERS) <= sanitizers(rules.read_json_rules(rules.RULES / "sanitizers.json"))
