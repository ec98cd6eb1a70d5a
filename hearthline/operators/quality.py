"""Listing quality: what is wrong with a record, and how complete it is. Lengths count bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the fields (their sum is 100), messages and suspicious phrases.
WEIGHTS = {"endereco": 25, "descricao": 20, "cidade": 20, "valor": 15, "quartos": 5, "area_total": 4, "banheiros": 3, "tipo_imovel": 3, "bairro": 2, "cep": 2}
PHRASES = ("show room de negócios imobiliários", "gedaim - gerenciamento", "lista de imóveis", "catálogo de propriedades", "múltiplas opções")


def _list(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(message)) for c, message in found]))


def errors() -> Column:
    valor, area = F.col("valor"), F.col("area_total")
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | F.lower("descricao").contains(p)
    return _list(
        (F.col("url") == "", "URL é obrigatória"),
        ((F.col("endereco") == "") & (valor <= 0), "Endereço ou valor deve estar presente"),
        ((valor > 0) & (valor < 1000), "Valor muito baixo, provavelmente inválido"),
        (valor > 100_000_000, "Valor muito alto, provavelmente inválido"),
        (F.length(F.regexp_replace("endereco", "[^,]", "")) > 5, "Endereço suspeito de conter dados agregados"),
        (phrase, "Descrição contém frases suspeitas de catálogo"),
        (F.col("quartos") > 50, "Número de quartos impossível"),
        (F.col("banheiros") > 20, "Número de banheiros impossível"),
        ((area > 0) & (area < 10) & (F.col("tipo_imovel") != "Terreno"), "Área muito pequena para o tipo de imóvel"),
    )


def warnings() -> Column:
    descricao, endereco = F.octet_length("descricao"), F.octet_length("endereco")
    return _list(
        ((descricao > 0) & (descricao < 20), "Descrição muito curta"),
        ((endereco > 0) & (endereco < 10), "Endereço muito genérico"),
        ((F.col("quartos") == 0) & (F.col("tipo_imovel") != "Terreno"), "Número de quartos não informado"),
        (F.col("area_total") == 0, "Área total não informada"),
        (F.col("cidade") == "", "Cidade não identificada"),
    )


def field_scores() -> dict[str, Column]:
    c = F.col
    endereco, descricao, cep = (F.octet_length(x) for x in ("endereco", "descricao", "cep"))
    some = lambda x: F.when(c(x) == "", 0.0).otherwise(1.0)
    few = lambda x, most: F.when(c(x) <= 0, 0.0).when(c(x) > most, 0.3).otherwise(1.0)
    return {
        "endereco": F.when(endereco == 0, 0.0).when(endereco < 10, 0.3).when(endereco >= 20, 1.0).otherwise(0.7),
        "descricao": F.when(descricao == 0, 0.0).when(descricao < 20, 0.2).when(descricao < 50, 0.5).when(descricao >= 100, 1.0).otherwise(0.8),
        "cidade": some("cidade"),
        "valor": F.when(c("valor") <= 0, 0.0).when((c("valor") < 10_000) | (c("valor") > 50_000_000), 0.3).otherwise(1.0),
        "quartos": few("quartos", 10),
        "area_total": F.when(c("area_total") <= 0, 0.0).when((c("area_total") < 20) | (c("area_total") > 10_000), 0.3).otherwise(1.0),
        "banheiros": few("banheiros", 8),
        "tipo_imovel": F.when(c("tipo_imovel").isin("", "Outro"), 0.0).otherwise(1.0),
        "bairro": some("bairro"),
        "cep": F.when(cep == 0, 0.0).when(cep.isin(8, 9), 1.0).otherwise(0.5),
    }


def completeness() -> Column:
    """0 to 100; listings without a features column miss its one point."""
    total = F.lit(0.0)
    for field, value in field_scores().items():
        total = total + value * WEIGHTS[field]
    return F.round(total, 6)


def valid_for_saving() -> Column:
    return (completeness() >= 60) & (F.size(errors()) == 0)
